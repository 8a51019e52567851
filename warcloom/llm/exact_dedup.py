"""Exact deduplication with streaming state.

Documents are fingerprinted once: digest, stable identifier (doc_id) and content locator (file and row). The
fingerprints are a stream; Structured Streaming keeps one state row for each digest in RocksDB on the executors' disks,
without watermark or expiry, holding the identifier and locator of the digest's first document and a count. The texts
don't travel with the stream. On a hit, the full bytes of both documents are fetched by their locators and compared;
documents whose digest is equal and whose bytes are not go on as distinct contents.

The state is kept by Spark's own aggregation (JVM, codegen): a Python state function costs over ten times as much a key.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, file_system, new_dir, remove

FILE, ROW = "__content_file", "__content_row"
#: Bytes of fingerprints that a micro-batch takes at most.
BATCH_BYTES = 64 << 30
#: Bytes of fingerprint files for each partition of the state.
STATE_BYTES = 8 << 20
#: Rows of a file that one fetch covers; about a row group, which is decoded from its start.
FETCH_ROWS = 1 << 20


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _is_parquet_scan(docs: DataFrame) -> bool:
    """Whether docs is a scan of Parquet files and nothing else: then a row's file holds its text, under its name, as it is."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString().lower() == "parquet"


def located(docs: DataFrame) -> DataFrame:
    """docs with the file and row that hold each one. What isn't a plain scan of Parquet files (a projection, a filter, a
    join, other formats) is written to the shared folder first, so that a locator always leads to the text of docs."""

    def add(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", meta["file_path"].alias(FILE), meta["row_index"].alias(ROW))

    clash = [c for c in docs.columns if c.lower() in (FILE, ROW)]
    if clash:
        raise ValueError(f"columns of these names hold locators here: {', '.join(clash)}")
    return add(docs if _is_parquet_scan(docs) else cut(docs, new_dir(docs.sparkSession, "contents")))


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """located docs with a number of their own for each row: a hash of the file, told apart from all others, and the row in it."""
    found = located(docs)
    files = found.select(FILE).distinct()
    seed = 0
    while True:
        number = F.shiftright(F.xxhash64(FILE, F.lit(seed)), 32)
        n, apart = files.agg(F.count("*"), F.countDistinct(number)).first()
        if n == apart:
            return found.withColumn(name, F.shiftleft(number, 32) + F.col(ROW))
        seed += 1


def state_partitions(spark: SparkSession, fingerprints: str) -> int:
    """Partitions of the state, by the size of the fingerprints: a task for each core at least.

    spark.sql.shuffle.partitions suits tables of texts; the fingerprints are a fiftieth of those, and nothing coalesces the
    partitions of a stream. Each of them opens a RocksDB and commits a set of files of its own, and on a mounted file system
    without Hadoop's native library the executor starts a process or more for each file that it makes.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fingerprints)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // STATE_BYTES))


def first_seen(spark: SparkSession, fingerprints: str, schema, at: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Digests seen more than once, with the first document of each. Runs the stream over what the folder holds now.

    The first is of the earliest micro-batch, in it of the lowest doc_id (null last), then of the lowest locator. A
    second run with the same folder `at` goes on from the stored state.
    """
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(fingerprints)
    state = stream.where("digest IS NOT NULL").withColumn("seen", F.current_timestamp()).groupBy("digest").agg(F.min(F.struct("seen", F.col("doc_id").isNull().alias("unnamed"), "doc_id", FILE, ROW)).alias("first"), F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.where("n > 1").select("digest", "first.doc_id", f"first.{FILE}", f"first.{ROW}").write.mode("overwrite").parquet(f"{at}/seen/batch={number}")

    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(state_partitions(spark, fingerprints))}
    before = {name: spark.conf.get(name, None) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        state.writeStream.outputMode("update").option("checkpointLocation", f"{at}/stream").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    try:
        seen = spark.read.parquet(f"{at}/seen")
    except AnalysisException:  # no documents, so no batch
        seen = spark.createDataFrame([], f"digest binary, doc_id long, {FILE} string, {ROW} long")
    return seen.select("digest", F.col("doc_id").alias("first_doc_id"), F.col(FILE).alias("first_file"), F.col(ROW).alias("first_row")).dropDuplicates(["digest"])


def _fetch(key, table):
    """The texts of rows of one file, read from its row groups that hold them, some rows at a time."""
    from urllib.parse import unquote

    import numpy as np
    import pyarrow.parquet as pq

    file = key[0].as_py()
    fs, path = file_system(unquote(file))
    rows = np.unique(table[ROW].to_numpy())
    texts, found = [], []
    with fs.open_input_file(path) as f:
        pf = pq.ParquetFile(f)
        at = 0
        for g in range(pf.num_row_groups):
            n = pf.metadata.row_group(g).num_rows
            inside = rows[np.searchsorted(rows, at) : np.searchsorted(rows, at + n)]
            if len(inside):
                start = at
                for batch in pf.iter_batches(batch_size=1024, row_groups=[g], columns=["text"]):
                    mine = inside[np.searchsorted(inside, start) : np.searchsorted(inside, start + len(batch))]
                    if len(mine):
                        texts.append(batch.column(0).cast(pa.string()).take(pa.array(mine - start)))
                        found.append(mine)
                    start += len(batch)
                    if start > inside[-1]:
                        break
            at += n
    text = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
    row = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pa.table({FILE: pa.array([file] * len(row), pa.string()), ROW: pa.array(row, pa.int64()), "text": text})


def fetch(locators: DataFrame) -> DataFrame:
    """The texts at (file, row): only files and row groups that are named are read, and nothing else is shuffled."""
    part = F.floor(F.col(ROW) / F.lit(FETCH_ROWS)).alias("part")
    return locators.select(FILE, ROW, part).groupBy(FILE, "part").applyInArrow(_fetch, f"{FILE} string, {ROW} long, text string")


def exact_duplicates(docs: DataFrame, digest=sha256, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The located documents, the fingerprints, and the duplicates (locator, doc_id, first_doc_id) with equal bytes.

    A null text is no content: it duplicates nothing. Empty texts are equal. A row without doc_id can be a duplicate,
    and is a first only if no row of the same content has an id. Repeated rows, even with one doc_id, are duplicates
    but for one. `digest` is a function of the text column; a weak one costs comparisons, not correctness.
    """
    spark = docs.sparkSession
    docs = located(docs)
    at = new_dir(spark, "exact-dedup")
    content = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), FILE, ROW)
    prints = cut(content.select("doc_id", digest(F.col("text")).alias("digest"), FILE, ROW), f"{at}-prints")
    firsts = cut(first_seen(spark, f"{at}-prints", prints.schema, at, batch_bytes), f"{at}/firsts")
    hits = cut(prints.join(firsts, "digest").where((F.col(FILE) != F.col("first_file")) | (F.col(ROW) != F.col("first_row"))), f"{at}/hits")
    wanted = hits.select(FILE, ROW).unionByName(hits.select(F.col("first_file").alias(FILE), F.col("first_row").alias(ROW))).distinct()
    texts = cut(fetch(wanted), f"{at}/texts")
    both = hits.join(texts, [FILE, ROW]).join(texts.select(F.col(FILE).alias("first_file"), F.col(ROW).alias("first_row"), F.col("text").alias("first_text")), ["first_file", "first_row"])
    checked = cut(both.select(FILE, ROW, "digest", "doc_id", "first_doc_id", (F.col("text").cast("binary") == F.col("first_text").cast("binary")).alias("same")), f"{at}/checked")
    out = checked.where("same").select(FILE, ROW, "doc_id", "first_doc_id")
    other = checked.where("NOT same")
    if not other.isEmpty():  # contents that share a digest with another: told apart by their bytes
        apart = other.select(FILE, ROW, "digest", "doc_id").join(texts, [FILE, ROW]).withColumn("key", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", FILE, ROW))
        least = apart.groupBy("digest", "text").agg(F.min("key").alias("first"))
        again = apart.join(least, ["digest", "text"]).where("key <> first").select(FILE, ROW, "doc_id", F.col("first.doc_id").alias("first_doc_id"))
        out = out.unionByName(again)
    out = cut(out, f"{at}-duplicates")
    remove(spark, at)
    return docs, prints, out


def exact_dedup(docs: DataFrame, digest=sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A row for each document: doc_id, first_doc_id (its own where it is the first of its content), is_duplicate."""
    _, prints, dup = exact_duplicates(docs, digest, batch_bytes)
    dup = dup.select(FILE, ROW, "first_doc_id", F.lit(True).alias("is_duplicate"))
    joined = prints.select("doc_id", FILE, ROW).join(dup, [FILE, ROW], "left")
    again = F.coalesce("is_duplicate", F.lit(False))
    return joined.select("doc_id", F.when(again, F.col("first_doc_id")).otherwise(F.col("doc_id")).alias("first_doc_id"), again.alias("is_duplicate"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without those whose content came before, columns as they were."""
    found, _, dup = exact_duplicates(docs)
    # one plan at every size: both sides are hashed by locator, the duplicates' locators being the table that is built
    return found.join(dup.select(FILE, ROW).hint("shuffle_hash"), [FILE, ROW], "left_anti").select(*[found[c] for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP1_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE first_value(doc_id) OVER w END AS first_doc_id,
  text IS NOT NULL AND row_number() OVER w > 1 AS is_duplicate
FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
"""
