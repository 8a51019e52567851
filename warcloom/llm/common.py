"""Shared helpers: the cluster's shared folder, cut tables, and vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or where that is unset (tests) one made here."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="warcloom-"))
        atexit.register(shutil.rmtree, _own_dirs[0], ignore_errors=True)
    return "file://" + _own_dirs[0]


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders through Hadoop's file system, so any shared store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def cut(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """Write df to a table in the shared folder and read it back: later stages start from files that outlive any executor."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_tokens(text: str | Column = "text") -> Column:
    """Length in byte-level tokens: UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def one_row_per_id(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """Rows with an id, one for each id. Where ids repeat, the row with the greatest value stays; ids alone are shuffled to find out."""
    df = df.where(F.col(id_col).isNotNull())
    if df.groupBy(id_col).count().where("count > 1").isEmpty():
        return df
    return df.groupBy(id_col).agg(F.max(value).alias(value))


# ---- kernels

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        a = np.full(1 << max(16, math.ceil(math.log2(n + 1))), base, dtype=np.uint64)
        a[0] = 1
        have = _powers[name] = np.multiply.accumulate(a)
    return have[:n]


def text_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array, null as empty, without copying."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = 1 << 20):
    """Runs of whole documents of about so many bytes; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the documents that offsets bound: the document number and a 64-bit hash of each run of bytes that aren't white space."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_SPACE[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    bounds = (offsets[:-1] - base)[np.diff(offsets) > 0]
    starts[bounds] |= word[bounds]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = (offsets[1:] - base)[np.diff(offsets) > 0] - 1
    ends[last] |= word[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=total[1:])
    h = mix((total[e] - total[s]) * _power("down", _INVERSE, n)[s])
    return np.searchsorted(offsets[1:] - base, s, side="right"), h


def gram_hashes(doc: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of words by document, sorted by document and hash. A document of fewer words has one gram, all of them."""
    if not len(word):
        return doc, word
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, len(doc)])
    grams = np.maximum(count - n + 1, 1)
    at = np.arange(int(grams.sum())) + np.repeat(first - np.cumsum(grams) + grams, grams)
    h = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    short = np.repeat(count, grams) if (count < n).any() else None
    for k in range(n):
        fresh = mix(h * np.uint64(0x9E3779B97F4A7C15) + (word[at + k] if short is None else word[np.minimum(at + k, len(word) - 1)]))
        h = fresh if short is None else np.where(short > k, fresh, h)
    d = doc[at]
    order = order_of(h, d)
    d, h = d[order], h[order]
    fresh = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]
    return d[fresh], h[fresh]


def order_of(key: np.ndarray, *groups: np.ndarray) -> np.ndarray:
    """An order by the last of the groups, then by those before it, then by key. Groups are whole numbers from 0, and short
    ones are sorted by radix; rows that are equal in all have no order of their own."""
    order = np.argsort(key)
    for g in groups:
        g = g[order]
        most = int(g.max()) if len(g) else 0
        order = order[np.argsort(g.astype(np.uint8) if most < 256 else g.astype(np.uint16) if most < 65_536 else g, kind="stable")]
    return order


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest member of each of 0..n-1's connected component under the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return root


def pieces(batches, rows: int = 256):
    """Batches in slices of few rows: Python objects are made for these alone. Memory that is free goes back at the end."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    trim()


def trim() -> None:
    """Hand free memory back to the system: a worker lives on for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def spread(x: np.ndarray) -> np.ndarray:
    """int64 ids to well-mixed uint64."""
    return mix(x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def file_system(path: str):
    """pyarrow's file system of a path or URI, and the path in it: any store that pyarrow knows, on every machine the same."""
    import pyarrow.fs

    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)
