"""Token counts of documents in flat, unindexed files of token identifiers.

A file is a run of fixed-width little-endian identifiers; an end-of-document identifier closes each document. Files are
cut into blocks at any offsets. A block is searched for the separator in one vectorised comparison and reports how many
it holds, the tokens before its first and after its last, and the lengths between. A prefix scan over the blocks'
summaries stitches documents that cross boundaries and numbers all of them, so no block waits for another.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, file_system, new_dir, remove

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD, WIDTH = 50_256, 2
#: Bytes in a block.
BLOCK = 8 << 20

_SUMMARY = "file string, block long, n long, before long, after long, lengths binary"


def _read_blocks(eod: int, width: int, block: int):
    kind = np.dtype(f"<u{width}")

    def run(batches):
        for b in batches:
            for file, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = file_system(file)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(block, f.size() - k * block), k * block), kind)
                at = np.flatnonzero(ids == eod)
                first = int(at[0]) if len(at) else len(ids)
                after = len(ids) - int(at[-1]) - 1 if len(at) else len(ids)
                lengths = (np.diff(at) - 1).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.string()), (k, pa.int64()), (len(at), pa.int64()), (first, pa.int64()), (after, pa.int64()), (lengths, pa.binary()))], names=["file", "block", "n", "before", "after", "lengths"])

    return run


def _documents(batches):
    """Stitched blocks to (file, number, tokens)."""
    for b in batches:
        for file, n, base, before, carried, lengths in zip(*(c.to_pylist() for c in b.columns)):
            if n:
                tokens = np.r_[before + carried, np.frombuffer(lengths, np.int32)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(base + np.arange(n), pa.int64()), pa.array(tokens, pa.int64())], names=["file", "number", "tokens"])


def count_tokens(spark: SparkSession, files: DataFrame, eod: int = EOD, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, number, tokens): the tokens of the number-th document of each file, the separator not counted.

    `files` has file (a path or URI that all executors can open) and size in bytes. Tokens after a file's last separator are a
    document that was never closed and follow as one more row; a file that is empty or ends with its separator has none.
    Two separators in a row are a document of 0 tokens. Repeated files are counted once. A size that the width doesn't
    divide is an error.
    """
    if block % width:
        raise ValueError("a block must hold whole identifiers")
    files = files.select("file", F.col("size").cast("long").alias("size")).where("file IS NOT NULL").dropDuplicates(["file"])
    if not files.where(F.col("size") % width != 0).isEmpty():
        raise ValueError("a file's size isn't a multiple of the identifier's width")
    parts = files.where("size > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.lit(block)).cast("long"))).alias("block"))
    at = new_dir(spark, "token-blocks")
    spread = parts.repartition("file", "block")
    read = cut(spread.mapInArrow(_read_blocks(eod, width, block), _SUMMARY), at)
    # the prefix scan: over one short row a block, the lengths staying where they are
    found = read.drop("lengths")
    w = W.partitionBy("file").orderBy("block")
    whole = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # tokens carried into a block: the after of the last block with a separator, and all blocks since
    total = F.coalesce(F.sum("after").over(whole), F.lit(0))
    reset = F.sum("after").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("after")
    last = F.max(F.when(F.col("n") > 0, F.struct("block", F.col("reset").alias("reset")))).over(whole)
    scanned = found.withColumn("reset", reset).withColumn("base", F.coalesce(F.sum("n").over(whole), F.lit(0))).withColumn("carried", total - F.coalesce(last["reset"], F.lit(0)))
    whole_blocks = scanned.where("n > 0").select("file", "block", "n", "base", "before", "carried").join(read.select("file", "block", "lengths"), ["file", "block"])
    docs = whole_blocks.select("file", "n", "base", "before", "carried", "lengths").mapInArrow(_documents, "file string, number long, tokens long")
    end = scanned.groupBy("file").agg(F.max_by(F.struct(F.col("base") + F.col("n"), F.when(F.col("n") > 0, F.col("after")).otherwise(F.col("carried") + F.col("after"))), "block").alias("e"))
    tail = end.select("file", F.col("e.col1").alias("number"), F.col("e.col2").alias("tokens")).where("tokens > 0")
    return docs.unionByName(tail)


def encoder(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _write_files(folder: str, vocabulary: str, eod: int, width: int):
    kind = np.dtype(f"<u{width}")

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        task = TaskContext.get()
        # a name of its own for each attempt: a lost or repeated attempt leaves a file that no row names
        file = f"{folder}/{task.partitionId():07d}-{task.taskAttemptId()}.bin"
        fs, path = file_system(file)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        number, size = 0, 0
        with fs.open_output_stream(path, buffer_size=1 << 20) as f:
            for b in batches:
                ids = []
                for text in b.column(1).to_pylist():
                    tokens = np.array(enc.encode_ordinary(text) if text else [], kind)
                    f.write(tokens.tobytes())
                    f.write(np.array([eod], kind).tobytes())
                    size += (len(tokens) + 1) * width
                    ids.append(number)
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(ids), pa.string()), pa.array(ids, pa.int64()), b.column(0), pa.array([None] * len(ids), pa.int64())], names=["file", "number", "doc_id", "size"])
        yield pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([size], pa.int64())], names=["file", "number", "doc_id", "size"])

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, eod: int = EOD, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """One flat file a task in the folder; returns (file, size) and the order of the documents (file, number, doc_id)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(_write_files(folder, vocabulary, eod, width), "file string, number long, doc_id long, size long")
    rows = cut(rows, folder + "-order", "zstd")
    return rows.where("number IS NULL").select("file", "size"), rows.where("number IS NOT NULL").select("file", "number", "doc_id")


def document_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) for every row of docs: its text is encoded into flat files, which are then counted.

    Null and empty texts have 0 tokens. Rows without doc_id, and repeated rows, are counted each on their own. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    folder = new_dir(spark, "tokens")
    files, order = write_token_files(docs, folder, vocabulary)
    out = cut(count_tokens(spark, files).join(order, ["file", "number"]).select("doc_id", "tokens"), folder + "-counts")
    remove(spark, folder, folder + "-order")
    return out


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(documents(spark, sf_dir))
