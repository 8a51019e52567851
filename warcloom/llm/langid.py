"""Language identification with bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of the n-grams (of bytes, over lower-case text) common in its labelled sample. The
filters share hash functions and are stored sliced: word j holds bit j of all filters, so k lookups and an AND return
the mask of all languages that contain an n-gram. A document's popcounts by language are corrected for each filter's
measured rate of false positives, and the largest corrected share decides.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, new_dir, slices, text_buffers

#: Bytes in an n-gram, hash functions, and bits in each filter as a power of two, at least: filters grow with their n-grams.
N, HASHES, BITS = 4, 3, 18
#: Labelled documents of each language that the filters are built from at most: those with the lowest MD5 of doc_id.
MAX_LABELLED = 1_500
#: Share of a language's sampled documents that must have an n-gram.
MIN_SHARE = 0.02
#: A language must explain this share of the n-grams, or the document is undetermined ("und").
MIN_SCORE = 0.3
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def gram_codes(data: np.ndarray) -> np.ndarray:
    """The N bytes from each position as one number."""
    n = max(0, len(data) - N + 1)
    code = np.zeros(n, np.uint64)
    for k in range(N):
        code |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return code


def _slots(code: np.ndarray, bits: int):
    for seed in _SEEDS[:HASHES]:
        yield ((code * seed) ^ (code * seed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)


@dataclass
class Filters:
    languages: list[str]
    words: np.ndarray  # slot -> mask of the languages whose filter has the slot's bit set
    rates: np.ndarray  # false positives of each filter

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], bits: int = BITS) -> Filters:
        languages = sorted(grams)
        most = max((len(g) for g in grams.values()), default=0)
        while most * HASHES > 1 << (bits - 1):  # at most about 40 % of a filter's bits are set
            bits += 1
        if len(languages) > 64:
            raise ValueError("a mask holds 64 languages")
        kind = next(t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= most)
        words = np.zeros(1 << bits, kind)
        for k, lang in enumerate(languages):
            for slot in _slots(grams[lang], bits):
                words[slot] |= kind(1 << k)
        fill = [float(((words >> kind(k)) & kind(1)).mean()) for k in range(len(languages))]
        return cls(languages, words, np.array(fill) ** HASHES)

    def masks(self, code: np.ndarray) -> np.ndarray:
        bits = int(len(self.words)).bit_length() - 1
        out = None
        for slot in _slots(code, bits):
            out = self.words[slot] if out is None else out & self.words[slot]
        return out

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the number of its n-grams, and by language the corrected share that the filter contains."""
        base = int(offsets[0])
        data = data[base : int(offsets[-1])]
        start = offsets[:-1] - base
        n = np.maximum(np.diff(offsets) - N + 1, 0)
        out = np.zeros((len(n), len(self.languages)))
        if n.sum():
            mask = self.masks(gram_codes(data))
            for k in range(len(self.languages)):
                total = np.zeros(len(mask) + 1, np.int64)
                np.cumsum((mask >> self.words.dtype.type(k)) & self.words.dtype.type(1), out=total[1:])
                hits = np.where(n > 0, total[np.minimum(start + n, len(mask))] - total[np.minimum(start, len(mask))], 0)
                out[:, k] = (hits / np.maximum(n, 1) - self.rates[k]) / (1 - self.rates[k])
        return n, np.clip(out, 0, 1)


def _document_grams(batches):
    """(lang, documents, grams, counts) of a partition: in how many documents each n-gram is."""
    count: dict[str, Counter] = {}
    number: Counter = Counter()
    for b in batches:
        langs = b.column(0).to_pylist()
        data, offsets = text_buffers(b.column(1))
        number.update(langs)
        for lang, i, j in zip(langs, offsets[:-1], offsets[1:]):
            count.setdefault(lang, Counter()).update(np.unique(gram_codes(data[i:j])).tolist())
    rows = [(lang, number[lang], np.array(list(c), np.uint64).tobytes(), np.array(list(c.values()), np.int64).tobytes()) for lang, c in count.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "n", "grams", "counts"])


def _common(key, table):
    """The n-grams of a language that MIN_SHARE of its sampled documents have: one language's sample is bounded."""
    n = sum(table["n"].to_pylist())
    code = np.concatenate([np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()])
    code, at = np.unique(code, return_inverse=True)
    count = np.bincount(at, np.concatenate([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()]), len(code))
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "grams": pa.array([code[count >= max(1, MIN_SHARE * n)].tobytes()], pa.binary())})


def train(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Filters:
    """Filters from at most max_labelled documents of each language that the lang column names."""
    w = W.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    named = docs.select(docs["doc_id"], docs["lang"]).where("doc_id IS NOT NULL AND lang IS NOT NULL AND lang <> ''")
    # the lowest hashes of each range of doc_ids first, so that no task ranks a whole language
    part = W.partitionBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(256))).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = named.withColumn("r", F.row_number().over(part)).where(F.col("r") <= max_labelled).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_labelled).select("doc_id").distinct()
    # max_labelled ids a language, and no more languages than a mask holds, fit in every executor; beyond that Spark decides
    chosen = cut(chosen, new_dir(docs.sparkSession, "langid-sample"))
    chosen = F.broadcast(chosen) if chosen.count() <= 64 * min(max_labelled, 10_000) else chosen
    sample = docs.select(docs["doc_id"], docs["lang"], docs["text"]).join(chosen, "doc_id").where("lang IS NOT NULL AND lang <> ''")
    counts = sample.select("lang", F.lower("text").alias("text")).mapInArrow(_document_grams, "lang string, n long, grams binary, counts binary")
    rows = counts.groupBy("lang").applyInArrow(_common, "lang string, grams binary").collect()
    grams = {r[0]: np.frombuffer(bytes(r[1]), np.uint64) for r in rows if r[1]}
    return Filters.build(grams) if grams else Filters([], np.zeros(1, np.uint8), np.zeros(0))


def _identify(filters: Filters):
    names = np.array([*filters.languages, "und"], dtype=object)

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            lang, score, margin, grams, also = [], [], [], [], []
            for i, j in slices(offsets):
                n, share = filters.shares(data, offsets[i : j + 1])
                if not filters.languages:
                    share = np.zeros((len(n), 1))
                best = share.argmax(1)
                top = share.max(1)
                second = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(n))
                best = np.where(top >= MIN_SCORE, best, len(names) - 1)
                lang += names[best].tolist()
                score.append(top), margin.append(top - second), grams.append(n)
                also += [[filters.languages[k] for k in np.flatnonzero(row >= MIN_SCORE)] if filters.languages else [] for row in share]
            cat = lambda x, t: pa.array(np.concatenate(x).round(6) if t == pa.float64() else np.concatenate(x), t)
            if lang:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), cat(score, pa.float64()), cat(margin, pa.float64()), pa.array(also, pa.list_(pa.string())), cat(grams, pa.int64())], names=["doc_id", "language", "score", "margin", "candidates", "n_grams"])

    return run


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, language, score, margin over the runner-up, all languages above MIN_SCORE, and n_grams, for every row of docs.

    Null, empty and very short texts (fewer than N bytes) have no n-gram: language 'und', score 0. Ties go to the first
    language by name. Rows without doc_id and repeated rows are each identified on their own. Other columns are ignored,
    whatever their names. With no labelled row at all every document is 'und'.
    """
    schema = "doc_id long, language string, score double, margin double, candidates array<string>, n_grams long"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lower(docs["text"]).alias("text")).mapInArrow(_identify(filters), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
