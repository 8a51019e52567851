"""Embeddings with a cosine of at least a threshold, by tiled comparison in PCA order: as pairs, or as classes with links counted.

Vectors are scaled to length 1 and rotated to their principal axes (found from the second moments of all rows), so the
leading dimensions hold most of every product. Rows are ordered by their leading coordinates and cut into blocks of tiles;
two blocks meet, and two tiles in them are compared, only if their boxes in the leading coordinates are near enough. Of a
pair of tiles the first slab of dimensions is multiplied; what is left is at most the product of the two suffix norms
(Cauchy-Schwarz), and the pairs of rows that it can lift to the threshold are multiplied in full: one by one, or all at once
where they are many. Products are first in single precision, and again in double wherever its error could decide.
Everything is exact. Vectors that have little to prune are all compared: the work is then quadratic, and a block's size,
up to BLOCK, keeps what is shuffled to as many copies of each row as there are blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, joined, new_dir, remove
from .ngram_join import AT_ONCE, _components, groups

THRESHOLD = 0.95
#: Rows of a tile, dimensions of a slab, and leading coordinates that bound a tile.
TILE, SLAB, BOX = 4096, 16, 4
#: Most rows of a block (of whole tiles; a longer tile is a block), rows that are compared with a block at a time, share of
#: pairs after the first slab from which all are multiplied in full, edges that a task holds, and bytes that one is sent.
BLOCK, ROWS, DENSE, EDGES, SENT = 16_384, 256, 1 / 256, 1 << 20, 64 << 20
_EPS = 1e-9


def _unit(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows (as float64, scaled) and which are usable: same length for all, finite, not zero."""
    lists = column.to_pylist()
    n = len(lists)
    d = max((len(x) for x in lists if x is not None), default=0)
    ok = np.array([x is not None and len(x) == d and None not in x for x in lists], bool)
    a = np.zeros((n, d))
    if ok.any():
        a[ok] = np.array([lists[k] for k in np.flatnonzero(ok)], float)
    norm = np.sqrt((a * a).sum(1))
    ok &= np.isfinite(norm) & (norm > 0)
    a[~ok] = 0
    return a / np.where(ok, norm, 1)[:, None], ok


def _moments(batches):
    total, count = {}, {}
    for b in batches:
        a, ok = _unit(b.column(0))
        d = a.shape[1]
        total[d] = total.get(d, 0) + a[ok].T @ a[ok]
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], names=["d", "m"])


def _added(key, table):
    m = sum(np.frombuffer(x) for x in table["m"].to_pylist())
    return pa.table({"d": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([m.tobytes()], pa.binary())})


def principal_axes(vectors: DataFrame, column: str, d: int) -> np.ndarray:
    """The axes as columns, largest moment first. Partial sums are added up in groups before they come to the driver."""
    parts = vectors.select(column).mapInArrow(_moments, "d long, m binary")
    parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = parts.where(F.col("d") == d).groupBy("d", "g").applyInArrow(_added, "d long, m binary").collect()
    total = sum((np.frombuffer(bytes(r[1])) for r in some), np.zeros(d * d)).reshape(d, d)
    value, axes = np.linalg.eigh(total)
    return axes[:, np.argsort(-value, kind="stable")]


def _rotate(axes: np.ndarray):
    d = len(axes)

    def run(batches):
        for b in batches:
            a, ok = _unit(b.column(1))
            if a.shape[1] != d:
                continue
            r = a[ok] @ axes
            ids = b.column(0).filter(pa.array(ok))
            if len(ids):
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(r[:, k] if k < d else np.zeros(len(r))) for k in range(BOX)), pa.array([x.tobytes() for x in r], pa.binary())], names=["id", *(f"c{k}" for k in range(BOX)), "v"])

    return run


class Rows:
    """Vectors of length 1 in both precisions, with the norms of what follows the first slab."""

    def __init__(self, v: np.ndarray, slab: int = SLAB):
        self.v, self.short = v, v.astype(np.float32)
        self.suffix = np.sqrt((v[:, slab:] ** 2).sum(1)).astype(np.float32)

    def __getitem__(self, k) -> Rows:
        out = object.__new__(Rows)
        out.v, out.short, out.suffix = self.v[k], self.short[k], self.suffix[k]
        return out

    def __len__(self) -> int:
        return len(self.v)


def _products(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for k in range(0, len(i), 1 << 14):
        out[k : k + (1 << 14)] = np.einsum("ij,ij->i", a.v[i[k : k + (1 << 14)]], b.v[j[k : k + (1 << 14)]])
    return out


def compare(a: Rows, b: Rows, t: float, slab: int = SLAB, listed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Index pairs of rows of a and b with product >= t, the products (rough ones, unless listed), and whether the first slab
    left many; a slab of 0 multiplies in full at once."""
    d = a.v.shape[1]
    slack, dense = (d + 8) * 2.0**-22, True  # more than single precision can be off by
    if 0 < slab < d:
        part = a.short[:, :slab] @ b.short[:, :slab].T
        hits = np.flatnonzero(part + np.outer(a.suffix, b.suffix) >= t - slack)
        dense = len(hits) > DENSE * part.size
        if not dense:
            i, j = np.divmod(hits, len(b))
            s = _products(a, b, i, j)
            keep = s >= t - _EPS
            return i[keep], j[keep], s[keep], dense
        part += a.short[:, slab:] @ b.short[:, slab:].T
    else:
        part = a.short @ b.short.T
    hits = np.flatnonzero(part >= t - slack)
    i, j = np.divmod(hits, max(1, len(b)))
    s = part.ravel()[hits].astype(float)
    again = np.arange(len(s)) if listed else np.flatnonzero(s < t + slack)
    s[again] = _products(a, b, i[again], j[again])
    keep = s >= t - _EPS
    return i[keep], j[keep], s[keep], dense


def _near_tiles(a: np.ndarray, b: np.ndarray, at: list[np.ndarray], far: float) -> np.ndarray:
    """Which tiles of a are within reach of which of b, by their boxes; at: where the tiles begin."""
    k = min(BOX, a.shape[1])
    lo, hi = ([f.reduceat(x[:, :k], y, axis=0) for x, y in zip((a, b), at)] for f in (np.minimum, np.maximum))
    gap = np.maximum(0, np.maximum(lo[0][:, None] - hi[1][None], lo[1][None] - hi[0][:, None]))
    return (gap * gap).sum(2) <= far * far


def _block(t: float, listed: bool):
    """Two blocks: their pairs, or the links of each vector and a forest of the classes."""
    far = _far(t)

    def side(table, prefix):
        order = np.argsort(table[f"{prefix}tile"].to_numpy(), kind="stable")
        tile = table[f"{prefix}tile"].to_numpy()[order]
        v = table[f"{prefix}v"].to_pylist()
        v = np.frombuffer(b"".join(v)).reshape(len(v), -1)[order] if v else np.zeros((0, 1))
        return table[f"{prefix}id"].to_numpy()[order], Rows(v), np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else np.zeros(0, np.int64)

    def run(key, left, right):
        (ids_a, a, at_a), (ids_b, b, at_b) = side(left, ""), side(right, "r")
        every, number = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
        mine, other = number[: len(ids_a)], number[len(ids_a) :]
        out, links, edges, held, slab = ([], [], []), np.zeros(len(every), np.int64), [], 0, SLAB
        if len(a) and len(b):
            near = _near_tiles(a.v, b.v, [at_a, at_b], far)
            of_a, of_b = (np.searchsorted(x, np.arange(len(y)), side="right") - 1 for x, y in ((at_a, a), (at_b, b)))
            for p in range(0, len(a), ROWS):
                reach = near[of_a[p] : of_a[min(p + ROWS, len(a)) - 1] + 1].any(0)
                if not reach.any():
                    continue
                within = None if reach.all() else np.flatnonzero(reach[of_b])
                i, j, s, dense = compare(a[p : p + ROWS], b if within is None else b[within], t, slab, listed)
                slab = 0 if dense else slab
                x, y = mine[i + p], other[j if within is None else within[j]]
                if key[0].as_py() == key[1].as_py():
                    keep = x < y
                    x, y, s = x[keep], y[keep], s[keep]
                if listed:
                    out[0].append(every[np.minimum(x, y)]), out[1].append(every[np.maximum(x, y)]), out[2].append(s)
                    continue
                links += np.bincount(x, minlength=len(every)) + np.bincount(y, minlength=len(every))
                edges.append((x, y))
                held += len(x)
                if held > EDGES:
                    edges, held = [_forest(len(every), edges)], 0
        if not listed:
            to, root = _forest(len(every), edges)
            up = np.arange(len(every))
            up[to] = root
            has = links > 0
            return pa.table({"id": pa.array(every[has], pa.int64()), "root": pa.array(every[up[has]], pa.int64()), "links": pa.array(links[has], pa.int64())})
        cat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"id_a": pa.array(cat[0].astype(np.int64)), "id_b": pa.array(cat[1].astype(np.int64)), "cosine": pa.array(cat[2].round(6), pa.float64())})

    return run


def _forest(n: int, edges: list) -> tuple[np.ndarray, np.ndarray]:
    """Edges between 0..n-1 as an edge from each number to the lowest that it is connected with, if that is another."""
    root = joined(n, *(np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1)))
    to = np.flatnonzero(root != np.arange(n))
    return to, root[to]


def _far(threshold: float) -> float:
    """The distance that vectors of the threshold's cosine are within: |a-b|^2 = 2 - 2cos."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9


def _bucket(bounds: list[float]):
    """A column function: how many of the bounds are at most the value."""
    at = np.array(sorted(bounds))

    @F.pandas_udf("long")
    def bucket(c: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, c.to_numpy(), side="right").astype(np.int64))

    return bucket


_PAIRS, _LINKS = "id_a long, id_b long, cosine double", "id long, root long, links long"


def _compared(vectors: DataFrame, threshold: float, id_col: str, column: str, tile: int, listed: bool, at: str, block: int | None = None) -> DataFrame:
    spark = vectors.sparkSession
    base = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[column].cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    if not base.groupBy("id").count().where("count > 1").isEmpty():
        base = base.groupBy("id").agg(F.max("v").alias("v"))
    size = base.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], _PAIRS if listed else _LINKS)
    d, n = size
    base = base.where(F.size("v") == d)
    axes = principal_axes(base, "v", d)
    coords = ", ".join(f"c{k} double" for k in range(BOX))
    rotated = cut(base.mapInArrow(_rotate(axes), f"id long, {coords}, v binary"), f"{at}/rotated")
    # strips of equal counts by the first coordinate, then tiles by the second within a strip, and blocks of those
    block = math.ceil((block or min(BLOCK, max(tile, 1024, n // 16))) / tile) * tile
    strips = max(1, math.isqrt(math.ceil(n / block)))
    strip_of = _bucket(rotated.approxQuantile("c0", [k / strips for k in range(1, strips)], 0.001) if strips > 1 else [])
    w = W.partitionBy("strip").orderBy("c1", "id")
    number = lambda size: F.floor((F.col("nth") - 1) / F.lit(size)).cast("long") * F.lit(strips) + F.col("strip")
    tiled = rotated.withColumn("strip", strip_of("c0")).withColumn("nth", F.row_number().over(w)).withColumns({"tile": number(tile), "block": number(block)})
    tiled = cut(tiled.select("block", "tile", "id", *(f"c{k}" for k in range(BOX)), "v"), f"{at}/tiled")
    boxes = cut(tiled.groupBy("block").agg(*(f(f"c{k}").alias(f"{n_}{k}") for k in range(BOX) for n_, f in (("lo", F.min), ("hi", F.max)))), f"{at}/boxes")
    # blocks meet in the strips that their box, widened by the threshold's distance, touches
    far = _far(threshold)
    near = boxes.select("*", F.explode(F.sequence(strip_of(F.col("lo0") - F.lit(far)), strip_of(F.col("hi0") + F.lit(far)))).alias("strip"))
    other = boxes.select(*(F.col(c).alias(f"r_{c}") for c in boxes.columns), F.pmod("block", F.lit(strips)).alias("strip"))
    gap = [F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"r_hi{k}"), F.col(f"r_lo{k}") - F.col(f"hi{k}")) for k in range(BOX)]
    reach = sum((g * g for g in gap), F.lit(0.0)) <= far * far
    pairs = cut(near.join(other, "strip").where((F.col("block") <= F.col("r_block")) & reach).select(F.col("block").alias("i"), F.col("r_block").alias("j")), f"{at}/pairs")
    meet = max(1, pairs.count())
    parts = min(meet, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(meet * 2 * block * (8 * d + 32) / SENT)))
    rows = tiled.select("block", "tile", "id", "v")
    left = rows.join(pairs, F.col("block") == F.col("i")).select("i", "j", "tile", "id", "v").repartition(parts, "i", "j")
    right = rows.join(pairs.select(F.col("i").alias("ri"), F.col("j").alias("rj")), F.col("block") == F.col("rj")).select("ri", "rj", *(F.col(c).alias(f"r{c}") for c in ("tile", "id", "v"))).repartition(parts, "ri", "rj")
    return left.groupBy("i", "j").cogroup(right.groupBy("ri", "rj")).applyInArrow(_block(threshold, listed), _PAIRS if listed else _LINKS)


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", column: str = "embedding", tile: int = TILE, block: int | None = None) -> DataFrame:
    """Pairs (id_a < id_b, cosine to six places) with cosine >= threshold.

    Left out: rows without id, null or zero vectors, vectors with nulls or that aren't finite, and vectors whose length
    isn't the most common one (the longer of equals). Of rows with one id the greatest vector counts. Equal vectors are
    pairs of cosine 1, in whatever tiles they are. Other columns are ignored, whatever their names. No rows give no pairs.
    """
    at = new_dir(vectors.sparkSession, "embeddings")
    out = cut(_compared(vectors, threshold, id_col, column, tile, True, at, block), f"{at}-out")
    remove(vectors.sparkSession, at)
    return out


def embedding_classes(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", column: str = "embedding", tile: int = TILE, block: int | None = None) -> DataFrame:
    """(the id column, class_id, n_links) for every id: how many other vectors have cosine >= threshold with it, and the
    lowest id of those that such links connect. Vectors that near_embeddings leaves out have no links and are classes of their own."""
    spark = vectors.sparkSession
    at = new_dir(spark, "embedding-classes")
    near = cut(_compared(vectors, threshold, id_col, column, tile, False, at, block), f"{at}-near")
    remove(spark, at)
    label = groups(_fewer(near.where("id <> root").select(F.col("root").alias("doc_a"), F.col("id").alias("doc_b")), f"{at}-near/edges"))
    links = near.groupBy("id").agg(F.sum("links").alias("links"))
    ids = vectors.select(vectors[id_col].cast("long").alias("id")).where("id IS NOT NULL").distinct()
    out = ids.join(links, "id", "left").join(label.withColumnRenamed("doc_id", "id"), "id", "left")
    out = cut(out.select(F.col("id").alias(id_col), F.coalesce("group", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")), f"{at}-out")
    remove(spark, f"{at}-near")
    return out


def _fewer(edges: DataFrame, path: str) -> DataFrame:
    """Edges that connect the same: a forest of each few million, where there are more than `groups` takes at once."""
    n = edges.count()
    if n <= AT_ONCE:
        return edges
    parts = math.ceil(n / (4 * AT_ONCE))
    some = edges.groupBy(F.pmod(F.hash("doc_a", "doc_b"), F.lit(parts)).alias("part")).applyInArrow(_components, "doc_id long, group long")
    return cut(some.where("doc_id <> group").select(F.col("group").alias("doc_a"), F.col("doc_id").alias("doc_b")), path)


LOOSE = 0.4


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def embedding_classes_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator at a threshold that unrelated vectors reach, so that small tables have links."""
    return embedding_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), LOOSE, tile=128)


def classes_sql(threshold: float) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold} - 1e-9
), link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), class AS (SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a
), links AS (SELECT a, count(*) AS n_links FROM link GROUP BY a
)
SELECT v.vec_id AS vec_id, coalesce(class_id, v.vec_id) AS class_id, coalesce(n_links, 0) AS n_links FROM v LEFT JOIN class ON v.vec_id = class.a LEFT JOIN links ON v.vec_id = links.a
"""


OP7_SQL, LOOSE_SQL = classes_sql(THRESHOLD), classes_sql(LOOSE)
