"""Quality rules whose cutoffs keep false rejection within a stated risk.

Each rule rejects documents in which a share is above a cutoff. For each stratum (language)
and rule, the cutoffs of a fixed grid are tested from the mildest to the strictest on the
labelled documents: is the rate at which good documents are rejected above ``alpha``? The
test is exact, the binomial tail P(X <= k | n, alpha). Testing stops at the first cutoff
that isn't shown to be safe (fixed sequence testing needs no correction within a grid), and
the level is divided by the number of grids in all (Bonferroni). So with probability
1 - ``delta`` every cutoff in use rejects at most ``alpha`` of its stratum's good documents;
a stratum with too few labels gets no cutoff and all its documents stay.

Counts are taken of whole texts, with array functions within a row. Windows of three words
are compared by a 64-bit hash.

Defined cases: a null text has no words, hence base_failed; a null lang is a stratum; of a
document's labels the lowest counts, null labels are left out; repeated rows are separate
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, WORD, documents, settle, whole

ALPHA, DELTA = 0.01, 0.05
SHARES = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
}


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words in windows of three words that the array holds twice or more."""

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

    def twice(s):
        return F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))

    def covered(places):
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(places), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda a: a["n"])

    count = bind(words, lambda w: bind(F.sort_array(windows(w)), lambda s: covered(F.transform(twice(s), lambda x: x["p"]))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(count).cast("long")


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, counts of the whole text, and the shares that rules test."""
    text = whole()
    without = lambda c, drop: F.length(F.translate(c, drop, ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rows = docs.select(*keep, text.alias("_text")).select(*keep, "_text", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"), lines.alias("_lines"))
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        without(F.col("_text"), SPACE).cast("long").alias("word_chars"),
        (F.length("_text") - without(F.col("_text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    return rows.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "upper_share": share("n_upper", "word_chars"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n and p, exact, summed as logarithms."""
    odds = F.lit(p / (1 - p))

    def step(a, i):
        term = a["term"] + F.when(i == 0, F.lit(0.0)).otherwise(F.log((n - i + 1) / i * odds))
        top = F.greatest(term, a["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(a["sum"] - top))).alias("sum"))

    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.lit(-1e300).alias("sum"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda a: F.exp(a["sum"]))


def cutoffs(good: DataFrame, stratum: str, shares: dict = SHARES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, a column for each share): the strictest cutoff shown to be safe, null where there is none. ``good``: labelled good rows."""
    tests = [(s, j, c) for s, grid in shares.items() for j, c in enumerate(sorted(grid, reverse=True))]
    rejected = [F.sum((F.col(s) > F.lit(c)).cast("long")).alias(f"{s}_{j}") for s, j, c in tests]
    rows = good.groupBy(stratum).agg(F.count("*").alias("_n"), *rejected)
    level = F.lit(delta) / (F.lit(len(shares)) * F.col("_strata"))
    rows = rows.withColumn("_strata", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row a stratum
    safe_at = lambda k: F.when(k >= alpha * F.col("_n"), False).otherwise(at_most(k, F.col("_n"), alpha) <= level)
    rows = rows.withColumns({f"_{s}_{j}": safe_at(F.col(f"{s}_{j}")) for s, j, _ in tests})
    for s in shares:
        best, safe = F.lit(None).cast("double"), F.lit(True)
        for _, j, c in (t for t in tests if t[0] == s):
            safe = safe & F.col(f"_{s}_{j}")
            best = F.when(safe, F.lit(c)).otherwise(best)
        rows = rows.withColumn(f"_cut_{s}", best)
    return rows.select(F.col(stratum).alias("_stratum"), *(f"_cut_{s}" for s in shares))


def judge(rows: DataFrame, labels: DataFrame, stratum: str = "lang", **risk) -> DataFrame:
    """``rows`` of counts() with kept: false if base_failed, or if a share is above its stratum's cutoff."""
    verdicts = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").alias("_quality"))
    good = rows.where(~F.col("base_failed")).join(verdicts.where("_quality = 1"), F.col("doc_id") == F.col("_doc"), "left_semi")
    cuts = cutoffs(good, stratum, **risk)
    shares = risk.get("shares", SHARES)
    above = reduce(lambda a, b: a | b, (F.coalesce(F.col(s) > F.col(f"_cut_{s}"), F.lit(False)) for s in shares))
    out = rows.join(cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~above).select(*rows.columns, "kept")


def op7_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = settle(counts(documents(spark, folder), "doc_id", "lang"))
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    return judge(rows, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    grid = ", ".join(f"('{s}', {j}, {c})" for s, g in SHARES.items() for j, c in enumerate(sorted(g, reverse=True)))
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 4),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM g),
n AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY rid),
c AS (
  SELECT doc_id, lang, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper
  FROM w LEFT JOIN n USING (rid)),
s AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
u AS (UNPIVOT (SELECT doc_id, lang, base_failed, symbol_share, repeat_share, dup_line_share, upper_share FROM s)
      ON symbol_share, repeat_share, dup_line_share, upper_share INTO NAME rule VALUE v),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
grid(rule, j, cut) AS (VALUES {grid}),
k AS (
  SELECT lang, rule, j, cut, count(*) AS n, count(*) FILTER (v > cut) AS k FROM u JOIN good USING (doc_id) JOIN grid USING (rule)
  WHERE NOT base_failed GROUP BY ALL),
p AS (
  SELECT *, k < n * {ALPHA} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))
                              FROM range(k + 1) AS _(i)) <= {DELTA}::DOUBLE / ({len(SHARES)} * (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM k)) AS safe FROM k),
q AS (SELECT lang, rule, cut, bool_and(safe) OVER (PARTITION BY lang, rule ORDER BY j) AS safe FROM p),
cuts AS (SELECT lang, rule, min(cut) AS cut FROM q WHERE safe GROUP BY ALL),
bad AS (SELECT DISTINCT u.doc_id FROM u JOIN cuts ON u.rule = cuts.rule AND u.lang IS NOT DISTINCT FROM cuts.lang WHERE v > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM s"""


QUERIES = {"op7_rules": op7_rules}
ORACLES = {"op7_rules": _oracle()}
