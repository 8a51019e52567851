"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads
it again as the next stage's docs. All but the last return the columns of documents, and other columns that docs have,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warcloom.llm.common import documents, new_dir
from warcloom.llm.exact_dedup import FILE, ROW, drop_exact_duplicates, keyed
from warcloom.llm.mixing import mix_in_order
from warcloom.llm.ngram_join import ngram_classes
from warcloom.llm.packing import pack_documents
from warcloom.llm.toxicity import drop_toxic, labels_of


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the classifier finds toxic go. Null, empty and blank texts stay, as do all rows without
    doc_id and repeated ones that aren't toxic; an empty table stays empty."""
    return drop_toxic(docs, labels_of(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of documents with the same bytes the first stays (lowest doc_id, null last). Null texts are no content and
    stay; of empty texts one stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each connected group of near duplicates one row stays.

    Every row is compared by itself, also without doc_id or where a doc_id repeats, and only the rows found go. The row
    with the lowest doc_id stays (null last), of equal ones that of the lowest file and row.
    """
    found = keyed(docs, "__key")
    member = ngram_classes(found.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), F.col("class_id").alias("group"))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", FILE, ROW)
    ranked = found.select("__key", rank.alias("rank")).join(member, "__key")
    stays = ranked.groupBy("group").agg(F.min_by("__key", "rank").alias("__key"))
    gone = member.join(stays, "__key", "left_anti").select("__key")
    return found.join(gone, "__key", "left_anti").select(*[found[c] for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents in training order; sources with more tokens than their target give fewer, others repeat.
    Null and empty texts have no tokens and go; null sources are one source."""
    return mix_in_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document's pieces, placed in bins; docs' order, the curriculum's, holds from shard to shard of bins.

    Null and empty texts, and documents without doc_id, are treated as pack_documents says.
    """
    return pack_documents(docs, in_order=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The toxicity model and the packing's local search have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_dir(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
