"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule, a piecewise linear function of training time in [0, 1].
Its integral is the source's share of the demand; water filling turns shares into targets
that no source exceeds by more than ``cap`` times its size. A source's documents queue in a
seeded hash order; a document whose place in the queue is the token count c is read at the
time at which the source's cumulative demand reaches c, the inverse of the integrated
schedule. Sorting all copies by that time, in ranges, gives the training order.

No task holds a source: a source's queue is cut into hash ranges, whose sizes are summed
first, so that each range only needs its own rows and one offset. Only the table of sources
is sorted in one task; it has one row a source.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its
own, after all others; repeated rows are separate documents; equal ids queue by size, and of
equal ids and sizes either may come first; a text of any length counts by its words; an empty
table gives an empty result; further columns of any names keep their values, save those that
this operator makes, which it replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import aside, documents, n_words, settle, unused

Schedule = Sequence[tuple[float, float]]

#: Front-loaded, level and late sources, whose integrals are 3, 1 and 2.
CURRICULUM: tuple[Schedule, ...] = (((0, 4.5), (1, 1.5)), ((0, 1), (1, 1)), ((0, 1), (1, 3)))
RANGES = 4096


def integral(s: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(s, s[1:]))


def check(s: Schedule) -> None:
    times = [t for t, _ in s]
    if len(s) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in s) < 0 or integral(s) <= 0:
        raise ValueError("a schedule runs from time 0 to 1 with weights of at least 0, not all 0")


def time_at(share: Column, s: Schedule) -> Column:
    """The time by which the given share of a schedule's integral has passed."""
    want, done, out = share * F.lit(float(integral(s))), 0.0, F.lit(1.0)
    pieces = []
    for (t0, w0), (t1, w1) in zip(s, s[1:]):
        slope, area = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
        left = F.greatest(want - F.lit(done), F.lit(0.0))
        if area > 0:
            root = F.sqrt(F.greatest(F.lit(w0 * w0 * 1.0) + 2 * slope * left, F.lit(0.0)))
            t = left / F.lit(w0 * 1.0) if slope == 0 else (root - F.lit(w0 * 1.0)) / F.lit(slope)
            pieces.append((done + area, F.lit(t0 * 1.0) + t))
        done += area
    for end, t in reversed(pieces):
        out = F.when(want <= F.lit(end), t).otherwise(out)
    return F.least(out, F.lit(1.0))


def targets(sizes: DataFrame, schedules: Sequence[Schedule], share: float, cap: float) -> DataFrame:
    """(source, source_size, pattern, target) from (source, source_size): demand by weight, none above cap times its size."""
    n, weight = len(schedules), F.array(*(F.lit(float(integral(s))) for s in schedules))
    everything, by_ratio = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("ratio", "rank")
    return (
        sizes.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("pattern", (F.col("rank") % n).cast("int"))
        .withColumn("weight", weight[F.col("pattern")])
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
        .select("source", "source_size", "pattern", "target")
    )


def assign(docs: DataFrame, size: Column, schedules: Sequence[Schedule] = CURRICULUM, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken and positions, the training times of the copies."""
    for s in schedules:
        check(s)
    made_here = ("size", "source_size", "target", "copies", "taken", "positions")
    given = unused(docs, "_given")
    docs, back = aside(docs.withColumn(given, size.cast("long")), "doc_id", "source", given)
    queue = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    made = docs.withColumns({"size": F.col(given), "_queue": queue}).withColumn("_range", F.shiftright("_queue", 48).cast("int"))
    ranges = made.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    to = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), schedules, share, cap)
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_range")) - F.col("_sum")
    ranges = ranges.withColumn("_before", before)
    ranges = ranges.join(to.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before", "source_size", "pattern", "target"
    )
    running = F.sum("size").over(Window.partitionBy("source", "_range").orderBy("_queue", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = made.withColumn("_in", running - F.col("size"))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    middle = F.col("_before") + F.col("_in") + F.col("size") / 2
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    more = (middle < F.col("target") - epochs * F.col("source_size")).cast("int")
    place = lambda k: F.least((k * F.col("source_size") + F.col("_middle")) / F.col("target"), F.lit(1.0))
    rows = rows.withColumns({"copies": (epochs + more).cast("int"), "_middle": middle})
    at = [F.when(F.col("copies") > k, time_of(place(F.lit(k)), schedules)) for k in range(int(cap) + 1)]
    return rows.withColumns({"taken": F.col("copies") * F.col("size"), "positions": F.array_compact(F.array(*at))}).select(
        *back(given, *made_here), *made_here
    )


def time_of(share: Column, schedules: Sequence[Schedule]) -> Column:
    out = F.lit(None).cast("double")
    for i, s in enumerate(schedules):
        out = F.when(F.col("pattern") == i, time_at(share, s)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def mix(docs: DataFrame, size: Column | None = None, **how) -> DataFrame:
    """The training order: the columns of ``docs``, a row for each copy, range-sorted by the copy's position."""
    n = size if size is not None else n_words(F.coalesce(F.col("text"), F.lit("")))
    words = unused(docs, "_words")
    own, back = aside(docs.withColumn(words, n), "doc_id", "source", words)
    rows = assign(own, F.col(words), **how).withColumn("position", F.explode("positions"))
    return rows.orderBy("position", "doc_id").select(*back(words, "position"), "position")


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    sized = settle(docs.select("doc_id", "source", n_words(F.coalesce(F.col("text"), F.lit(""))).alias("words")))  # read twice
    rows = assign(sized, F.col("words"))
    first = F.round(F.get("positions", F.lit(0)), 6).alias("first_position")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", first).orderBy(F.asc_nulls_last("first_position"), "doc_id")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(':' || doc_id::VARCHAR, '')), 1, 15))::BIGINT AS queue
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
c AS (
  SELECT *, rank % 3 AS pattern, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM w),
r AS (
  SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM c),
l AS (
  SELECT *, (total - (sum(cap) OVER (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING) - cap))
            / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (
  SELECT source, source_size, pattern,
         least(cap, coalesce(weight * (SELECT level FROM l WHERE ratio > level ORDER BY ratio, rank LIMIT 1), cap)) AS target FROM l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.pattern,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY queue, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, (epochs + (middle < target - epochs * source_size)::INT)::INT AS copies, least(middle / target, 1.0) AS u FROM q)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN round(least(1.0, CASE pattern
         WHEN 0 THEN (sqrt(20.25 - 6 * (u * 3)) - 4.5) / -3
         WHEN 1 THEN u ELSE (sqrt(1 + 4 * (u * 2)) - 1) / 2 END), 6) END AS first_position
FROM k"""

QUERIES = {"op1_mix": op1_mix}
ORACLES = {"op1_mix": ORACLE_SQL}
