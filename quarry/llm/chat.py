"""Chat formatting over logs that repeat a conversation each time it grows.

A service that logs the whole conversation after every turn leaves cumulative snapshots.
Every turn gets the rolling hash of the conversation up to it; a conversation whose full
hash is the hash of a shorter prefix of some other one is a snapshot of that, and an anti
join drops it. Equal conversations form one class, of which the smallest id stays. What
stays is rendered in parts of at most ``PART`` turns.

The rolling hash is a sum over turns of two 64-bit hashes of (position, role, text). Rows are
dealt to ranges of the order of conversations and turns, with a hash of a row's place in the input
as the last key, so that no conversation, turn number or repeated row is too frequent for one. Counts
and sums of each range are added up first, so that a conversation of any
length is spread over tasks; how turns are numbered doesn't enter the hash. Both joins are between distinct
keys, so that a very common first turn or conversation is one row on each side.

Defined cases: turns are ordered by turn (null last), role, the MD5 of the text, and repeated rows stay
separate turns; a text of any length is one turn and must fit a row; a null role is ``unknown`` and a null text empty; rows with a null conv_id
are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import order_bounds, order_bucket, parts_for

PART, RANGE_BYTES = 1024, 4 << 20


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n_turns, role, text and a, b, the rolling hash up to the turn."""
    wide = lambda c: c.cast("decimal(38,0)")
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    own = {"conv_null": F.col("conv_id").isNull(), "turn_null": F.col("turn").isNull(), "sum": F.md5("text")}
    rows, key = rows.withColumns(own), ["conv_null", "conv_id", "turn_null", "turn", "role", "sum", "salt"]
    bounds = order_bounds(rows.select(*key), parts_for(rows, F.octet_length("text") + F.octet_length("role") + 8, RANGE_BYTES))
    rows = rows.withColumn("block", order_bucket(F.struct(*key), rows.select(F.struct(*key).alias("k")).schema["k"].dataType.simpleString(), bounds)).drop("conv_null")
    order = ["turn_null", "turn", "role", "sum", "salt"]
    w = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)))
    upto, of = Window.partitionBy("conv_id").orderBy("block"), Window.partitionBy("conv_id")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.sum("n").over(of).alias("n_turns"), (F.sum("n").over(upto) - F.col("n")).alias("n0"))
    rows = rows.join(counts, same).drop("_c", "_b").withColumn("pos", F.col("n0") + F.col("place"))
    rows = rows.withColumn("ha", F.xxhash64("pos", "role", "text")).withColumn("hb", F.xxhash64(F.lit("b"), "text", "role", "pos"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum(wide(F.col("ha"))).alias("sa"), F.sum(wide(F.col("hb"))).alias("sb"))
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *((F.sum(c).over(upto) - F.col(c)).alias(f"{c}0") for c in ("sa", "sb")))
    rows = rows.withColumn("la", F.sum(wide(F.col("ha"))).over(w)).withColumn("lb", F.sum(wide(F.col("hb"))).over(w))
    rows = rows.join(blocks, same)
    return rows.select("conv_id", "pos", "n_turns", "role", "text", (F.col("sa0") + F.col("la")).alias("a"), (F.col("sb0") + F.col("lb")).alias("b"))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id and n_logged, the number of equal conversations, of those that are no prefix of a longer one. ``rows``: from prefixes()."""
    classes = rows.where("pos = n_turns").groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    inner = rows.where("pos < n_turns").select("pos", "a", "b").distinct()
    return classes.join(inner, ["pos", "a", "b"], "left_anti").select("conv_id", "n_logged")


def markup(role: Column, text: Column) -> Column:
    """One turn; a control mark within a text is broken up, so that no text can end its turn."""
    inert = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), inert(role), F.lit("\n"), inert(text), F.lit("<|im_end|>\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of the part), n_logged, rendered; concatenating the parts of a conversation gives it whole."""
    rows = prefixes(turns)
    keep = maximal(rows).withColumnRenamed("conv_id", "_keep")
    kept = rows.join(keep, F.col("conv_id").eqNullSafe(F.col("_keep")))
    part = F.floor((F.col("pos") - 1) / PART).cast("int").alias("part")
    lines = F.sort_array(F.collect_list(F.struct("pos", markup(F.col("role"), F.col("text")).alias("line"))))
    return (
        kept.groupBy("conv_id", part)
        .agg(F.count("*").alias("n_turns"), F.max("n_logged").alias("n_logged"), lines.alias("lines"))
        .select("conv_id", "part", "n_turns", "n_logged", F.array_join("lines.line", "").alias("rendered"))
    )


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    return render(spark.read.parquet(f"{folder.rstrip('/')}/conversations.parquet"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), md5(coalesce(text, ''))) AS pos
  FROM conversations),
p AS (
  SELECT *, list((role, text)) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
c AS (SELECT min(conv_id) AS conv_id, count(*) AS n_logged, upto FROM p WHERE pos = n GROUP BY upto),
k AS (SELECT conv_id, n_logged FROM c WHERE upto NOT IN (SELECT upto FROM p WHERE pos < n))
SELECT t.conv_id, ((pos - 1) // 1024)::INT AS part, count(*) AS n_turns, max(n_logged) AS n_logged,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1, 2"""

QUERIES = {"op5_chat": op5_chat}
ORACLES = {"op5_chat": ORACLE_SQL}
