"""Mixing sources to target weights that change over the course of training.

Each source has a weight schedule: piecewise linear between knots on [0, 1], all sources' weights adding to 1 at every
time. Its integral times the run's token budget is the source's cumulative token demand. A source's documents stand in a
fixed shuffled order; the document that begins after c tokens of its source is due when the demand reaches c, so its
training position is the demand's inverse at c. A source that runs out begins again (epoch 1, 2, ...); one with more
tokens than are asked for leaves the rest unscheduled. The run's documents are range-sorted by position.

Cumulative tokens are two-level prefix sums (within ranges of the shuffled order, then over the ranges' totals), so no
task holds a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, n_tokens, new_dir

#: Exponent of the sources' share of tokens at each knot: natural shares at the start, flatter ones later.
TEMPERATURE = ((0.0, 1.0), (0.5, 0.9), (1.0, 0.7))
#: Documents that a range of the shuffled order holds about.
RANGE = 100_000


def tempered_schedule(sources: DataFrame, knots=TEMPERATURE) -> DataFrame:
    """(source, knot, weight) from (source, tokens): share^exponent at each knot, scaled to add to 1."""
    total = W.partitionBy()
    share = F.col("tokens") / F.sum("tokens").over(total)
    points = F.explode(F.array(*[F.struct(F.lit(t).alias("knot"), F.lit(a).alias("a")) for t, a in knots])).alias("p")
    raw = sources.withColumn("share", share).select("source", "share", points).select("source", "p.knot", F.pow("share", "p.a").alias("raw"))
    return raw.select("source", "knot", (F.col("raw") / F.sum("raw").over(W.partitionBy("knot"))).alias("weight"))


def demand_segments(schedule: DataFrame) -> DataFrame:
    """The schedule's integral: for each source and pair of knots t0, t1, w0, w1 and the cumulative demand d0, d1. A row for each source and knot; schedules are small."""
    w = W.partitionBy("source").orderBy("knot")
    seg = schedule.select("source", F.col("knot").alias("t0"), F.lead("knot").over(w).alias("t1"), F.col("weight").alias("w0"), F.lead("weight").over(w).alias("w1")).where("t1 IS NOT NULL")
    area = (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2
    d1 = F.sum(area).over(W.partitionBy("source").orderBy("t0").rowsBetween(W.unboundedPreceding, 0))
    return seg.withColumn("area", area).withColumn("d1", d1).withColumn("d0", F.col("d1") - F.col("area"))


def curriculum(docs: DataFrame, schedule: DataFrame | None = None, budget: int | None = None, seed: str = "0") -> DataFrame:
    """(doc_id, source, tokens, epoch, position, ...) for each scheduled use of a document, with all columns of docs under `doc`.

    position in [0, 1) is the share of the run's token budget (default: all tokens that docs hold) after which the
    document begins. `schedule` has source, knot, weight; weights needn't add to 1. Sources that it doesn't name, or of
    weight 0 throughout, aren't used. Null sources are one source, ''. A null or empty text has no tokens and isn't
    scheduled. Documents without doc_id take part and order by their text's hash; of repeated rows each takes part.
    Documents keep all other columns whatever their names, as they stay inside `doc`.
    """
    spark = docs.sparkSession
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")))).alias("key")
    items = base.select("doc", F.coalesce(F.col("doc.source").cast("string"), F.lit("")).alias("source"), F.col("doc.doc_id").alias("doc_id"), n_tokens("doc.text").alias("tokens"), key).where("tokens > 0")
    slim = items.select("source", "tokens")
    sources = cut(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), new_dir(spark, "mixing-sources"))
    count, total = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    budget = int(budget or total)
    ranges = min(1 << 20, max(1, math.ceil(count / RANGE)))
    schedule = tempered_schedule(sources) if schedule is None else schedule
    schedule = schedule.select("source", "knot", (F.col("weight") / F.sum("weight").over(W.partitionBy("knot"))).alias("weight"))
    segments = demand_segments(schedule)
    need = segments.groupBy("source").agg((F.max("d1") * F.lit(budget)).alias("need"))
    part = F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 24)).alias("part")
    items = items.withColumn("part", part)
    totals = items.groupBy("source", "part").agg(F.sum("tokens").alias("part_tokens"))
    before = totals.select("source", "part", (F.sum("part_tokens").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("part_tokens")).alias("before"))
    inside = W.partitionBy("source", "part").orderBy("key", "doc_id", F.xxhash64("doc.text")).rowsBetween(W.unboundedPreceding, 0)
    placed = items.withColumn("within", F.sum("tokens").over(inside) - F.col("tokens")).join(before, ["source", "part"])
    placed = placed.join(sources.select("source", F.col("tokens").alias("held")).join(need, "source"), "source").withColumn("start", F.col("before") + F.col("within"))
    uses = F.greatest(F.lit(0), F.ceil((F.col("need") - F.col("start")) / F.col("held"))).cast("int")
    placed = placed.withColumn("uses", uses).where("uses > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    placed = placed.withColumn("due", (F.col("start") + F.col("epoch") * F.col("held")) / F.lit(float(budget)))
    seg = segments.select(F.col("source").alias("of"), "t0", "t1", "w0", "w1", "d0", "d1")
    hit = placed.join(seg, (F.col("source") == F.col("of")) & (F.col("due") >= F.col("d0")) & (F.col("due") < F.col("d1")))
    slope = (F.col("w1") - F.col("w0")) / (F.col("t1") - F.col("t0"))
    rest = F.col("due") - F.col("d0")
    # w0*x + slope*x*x/2 = rest, in the form that holds for slope 0 too
    x = 2 * rest / (F.col("w0") + F.sqrt(F.greatest(F.lit(0.0), F.col("w0") * F.col("w0") + 2 * slope * rest)))
    return hit.select("doc_id", "source", "tokens", "epoch", (F.col("t0") + F.when(rest == 0, 0.0).otherwise(x)).alias("position"), "doc")


def mix_in_order(docs: DataFrame, **options) -> DataFrame:
    """The scheduled documents in training order, columns as they were; a document of n epochs comes n times."""
    return curriculum(docs, **options).orderBy("position", "source", "doc_id").select("doc.*")


def op4_mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # rounded for the comparison with SQL only: documents are sorted by the position itself
    return curriculum(docs).drop("doc").orderBy("position", "source", "doc_id").withColumn("position", F.round("position", 9))


_EXPONENTS = ", ".join(f"({t}::DOUBLE, {a}::DOUBLE)" for t, a in TEMPERATURE)
OP4_SQL = f"""
WITH item AS (
  SELECT doc_id, coalesce(source, '') AS source, octet_length(encode(text)) AS tokens, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents WHERE text IS NOT NULL AND text <> ''
), src AS (SELECT source, sum(tokens)::BIGINT AS held FROM item GROUP BY 1
), total AS (SELECT sum(held)::BIGINT AS budget FROM src
), raw AS (SELECT source, t, power(held::DOUBLE / budget, a) AS r FROM src, total, (VALUES {_EXPONENTS}) e(t, a)
), sched AS (SELECT source, t, r / sum(r) OVER (PARTITION BY t) AS w FROM raw
), seg0 AS (SELECT source, t AS t0, lead(t) OVER o AS t1, w AS w0, lead(w) OVER o AS w1 FROM sched WINDOW o AS (PARTITION BY source ORDER BY t)
), seg1 AS (SELECT *, (t1 - t0) * (w0 + w1) / 2 AS area FROM seg0 WHERE t1 IS NOT NULL
), seg2 AS (SELECT *, sum(area) OVER (PARTITION BY source ORDER BY t0) AS d1 FROM seg1
), seg AS (SELECT *, d1 - area AS d0 FROM seg2
), need AS (SELECT source, max(d1) * (SELECT budget FROM total) AS need FROM seg GROUP BY 1
), placed AS (
  SELECT i.*, held, need, sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS start FROM item i JOIN src USING (source) JOIN need USING (source)
), used AS (
  SELECT *, unnest(range(0, greatest(0, ceil((need - start) / held))::BIGINT)) AS epoch FROM placed
), due AS (SELECT *, (start + epoch * held) / (SELECT budget FROM total)::DOUBLE AS due FROM used)
SELECT doc_id, due.source AS source, tokens, epoch::INT AS epoch,
  round(t0 + CASE WHEN due = d0 THEN 0 ELSE 2 * (due - d0) / (w0 + sqrt(greatest(0, w0 * w0 + 2 * ((w1 - w0) / (t1 - t0)) * (due - d0)))) END, 9) AS position
FROM due JOIN seg ON due.source = seg.source AND due >= d0 AND due < d1
"""
