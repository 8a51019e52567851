"""Packing documents into training sequences: best fit, then a local search that swaps and moves documents to empty bins.

A document longer than a bin is cut: full bins of its own, and the rest is packed like any other. Shards of documents
are packed on their own, only ids and lengths being shuffled: by a hash of the document, or by ranges of the order that
docs have in their files, so that a curriculum's order holds from shard to shard. Rows of a shard that share a doc_id
(epochs of a document) go to bins of different layers, so no bin holds a document twice.

The search takes the bins that aren't full, from the emptiest. It moves documents of the bin into the gaps of fuller
bins, exchanges one of them for a shorter document of a fuller bin, or two for one, always so that the fuller bin gains;
each step raises the sum of squared fills, so it ends. A bin that has lost all its documents is gone.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, n_tokens
from .exact_dedup import FILE, ROW, located

#: Byte-level tokens in a bin.
CAPACITY = 32_768
#: Pieces that a shard holds about.
SHARD = 8_192


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where it leaves the smallest gap."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (gap, bin), sorted
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(gaps, (sizes[k], -1))
        if at == len(gaps):
            bins.append([k])
            gap, b = capacity - sizes[k], len(bins) - 1
        else:
            gap, b = gaps.pop(at)
            bins[b].append(k)
            gap -= sizes[k]
        if gap:
            insort(gaps, (gap, b))
    return bins


class Search:
    """Local search over bins; fills and sorted indexes of gaps and of exchange slots follow every step."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.size, self.cap = sizes, capacity
        self.bins = {b: list(x) for b, x in enumerate(bins)}
        self.fill = {b: sum(sizes[k] for k in x) for b, x in self.bins.items()}
        self.gaps: list[tuple[int, int]] = []  # (gap, bin) of bins that aren't full
        self.slots: list[tuple[int, int, int, int]] = []  # (room once the item leaves, size, item, bin) in those bins
        for b in self.bins:
            self._add(b)

    def _add(self, b: int) -> None:
        gap = self.cap - self.fill[b]
        if gap and self.bins[b]:
            insort(self.gaps, (gap, b))
            for k in self.bins[b]:
                insort(self.slots, (gap + self.size[k], self.size[k], k, b))

    def _drop(self, b: int) -> None:
        gap = self.cap - self.fill[b]
        if gap and self.bins[b]:
            del self.gaps[bisect_left(self.gaps, (gap, b))]
            for k in self.bins[b]:
                del self.slots[bisect_left(self.slots, (gap + self.size[k], self.size[k], k, b))]

    def _exchange(self, a: int, give: list[int], b: int, take: list[int]) -> None:
        self._drop(a), self._drop(b)
        for k in give:
            self.bins[a].remove(k)
        for k in take:
            self.bins[b].remove(k)
        self.bins[a] += take
        self.bins[b] += give
        d = sum(self.size[k] for k in give) - sum(self.size[k] for k in take)
        self.fill[a] -= d
        self.fill[b] += d
        if not self.bins[a]:
            del self.bins[a], self.fill[a]
        else:
            self._add(a)
        self._add(b)

    def _gains(self, a: int, b: int, d: int) -> bool:
        """Whether d > 0 tokens from a to b fit and raise the sum of squares: (fb+d)^2 + (fa-d)^2 > fa^2 + fb^2."""
        return a != b and 0 < d <= self.cap - self.fill[b] and self.fill[b] + d > self.fill[a]

    def _step(self, a: int) -> bool:
        own = sorted(self.bins[a], key=lambda k: (-self.size[k], k))
        for k in own:  # move
            s = self.size[k]
            at = bisect_left(self.gaps, (s, -1))
            for i in range(at, len(self.gaps)):
                gap, b = self.gaps[i]
                if gap >= s + self.cap - self.fill[a]:  # from here on the fuller bin would be a itself
                    break
                if self._gains(a, b, s):
                    self._exchange(a, [k], b, [])
                    return True
        for k in own:  # one for one
            if self._swap(a, [k], self.size[k]):
                return True
        for i in range(len(own)):  # two for one
            for j in range(i + 1, len(own)):
                s = self.size[own[i]] + self.size[own[j]]
                if s <= self.cap and self._swap(a, [own[i], own[j]], s):
                    return True
        return False

    def _swap(self, a: int, give: list[int], s: int) -> bool:
        at = bisect_left(self.slots, (s, -1, -1, -1))
        # an item shorter than s leaves room below s and its bin's gap; from s and a's own gap on no exchange raises the sum
        other = next((gap for gap, b in reversed(self.gaps) if b != a), 0)
        most = s + min(self.cap - self.fill[a], other)
        for i in range(at, len(self.slots)):
            room, size, k, b = self.slots[i]
            if room >= most:
                break
            if self._gains(a, b, s - size):
                self._exchange(a, give, b, [k])
                return True
        return False

    def run(self) -> list[list[int]]:
        moved = True
        while moved:  # each step raises the sum of squares, so a round without one comes
            moved = False
            for _gap, a in sorted(self.gaps, reverse=True):
                # each step takes tokens out of bin a, so this ends
                while a in self.bins and self._step(a):
                    moved = True
        return [x for _, x in sorted(self.bins.items()) if x]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers for items of 1..capacity tokens."""
    return Search(sizes, best_fit(sizes, capacity), capacity).run() if sizes else []


def _shard(capacity: int):
    def run(key, table):
        shard = key[0].as_py()
        rows = sorted(zip(table["doc_id"].to_pylist(), table["piece"].to_pylist(), table["tokens"].to_pylist(), table["start"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        layers: list[list[int]] = []
        seen: dict[int, int] = {}
        for k, (doc, *_) in enumerate(rows):
            layer = 0 if doc is None else seen.get(doc, 0)
            if doc is not None:
                seen[doc] = layer + 1
            if layer == len(layers):
                layers.append([])
            layers[layer].append(k)
        out = {c: [] for c in ("doc_id", "piece", "bin_id", "bin_offset", "start", "tokens")}
        bins = [[own[k] for k in items] for own in layers for items in pack([rows[k][2] for k in own], capacity)]
        for b, items in enumerate(bins):
            offset = 0
            for k in sorted(items):
                doc, piece, tokens, start = rows[k]
                for c, v in zip(out, (doc, piece, f"{shard:010d}-{b}", offset, start, tokens)):
                    out[c].append(v)
                offset += tokens
        return pa.table({c: pa.array(v, pa.string() if c == "bin_id" else pa.int64()) for c, v in out.items()})

    return run


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (short ones, with the columns of `located`) with their number in the order of the files and of the rows in them."""
    counts = rows.groupBy(FILE).agg((F.max(ROW) + 1).alias("held"))
    before = F.coalesce(F.sum("held").over(W.orderBy(FILE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select(FILE, before.alias("before")), FILE).withColumn("rank", F.col("before") + F.col(ROW)).drop(FILE, ROW, "before")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, in_order: bool = False) -> DataFrame:
    """A row for each piece of a document: doc_id, piece, bin_id, bin_offset, start (in the document), tokens.

    A document without tokens (null or empty text) has no piece. Rows with the same doc_id are packed each on its own, in
    different bins; so are rows without doc_id, in any bins. Rows that are alike in id and length are interchangeable,
    and the result is the same however docs are partitioned. With in_order, docs being written files, bins hold documents
    that are near each other in the files' order, and bin_id begins with their place in it. Other columns are ignored,
    whatever their names. No documents give no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    shards = max(1, math.ceil(docs.select(F.lit(1)).count() / shard))
    own = [F.col("doc_id").cast("long").alias("doc_id"), n_tokens("text").alias("total")]
    if in_order:
        items = _ranked(located(docs).select(*own, FILE, ROW)).select("doc_id", "total", F.floor(F.col("rank") / F.lit(shard)).cast("long").alias("shard"))
    else:
        items = docs.select(*own, F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(shards)).cast("long").alias("shard"))
    items = items.where("total > 0")
    whole = F.floor(F.col("total") / F.lit(capacity)).cast("long")
    again = F.row_number().over(W.partitionBy("shard", "doc_id", "total").orderBy(F.lit(0)))
    full = items.where(F.col("total") >= capacity).withColumn("again", again).select("doc_id", "shard", "total", "again", F.posexplode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece", "_n"))
    name = F.concat(F.lpad(F.col("shard").cast("string"), 10, "0"), F.lit("-full-"), F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "total", "again", "piece"))
    full = full.select("doc_id", F.col("piece").cast("long").alias("piece"), name.alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), (F.col("piece") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("tokens"))
    rest = items.withColumn("tokens", (F.col("total") % F.lit(capacity)).cast("long")).where("tokens > 0").select("doc_id", whole.alias("piece"), (F.col("total") - F.col("tokens")).alias("start"), "tokens", "shard")
    packed = rest.groupBy("shard").applyInArrow(_shard(capacity), "doc_id long, piece long, bin_id string, bin_offset long, start long, tokens long")
    return packed.unionByName(full)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
