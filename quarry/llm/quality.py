"""A quality classifier made of sparse rules.

Shallow boosted trees are grown over statistics of a text. Each path from a root is a rule, a
conjunction of comparisons; a logistic regression with an absolute penalty (lasso) weighs the
rules and leaves few. The rules become one Spark column expression, so that scoring is a
projection within generated code.

The model is fitted on the driver on at most ``SAMPLE`` examples, an id with a label and the
statistics of a text, each with the number of times that it occurs as its weight. They are the
first by a hash of id and label among the different pairs of these whose hash is in the first share
of all hashes that holds about twice as many; statistics are taken of whole texts.

Defined cases: a null text is empty, and an empty text has all statistics 0 and is scored like
any other; equal labels of a document and its repeated rows weigh as often as they occur,
different labels are separate examples, null labels and ids are left out;
with one label value only, every score is that value's smoothed share, and 0.5 with none;
repeated rows are scored alike; of equal hashes the smaller id and label come first; texts of any length are scored by shares of the whole;
an empty table gives an empty result; further columns of documents and labels are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, WORD, documents, remainder, settle, whole

SAMPLE, TREES, DEPTH, BINS, PENALTY = 20_000, 40, 3, 32, 1e-3
THRESHOLD = 0.3

STATISTICS = (
    "words chars_per_word symbol_share bang_share bar_share mark_share upper_share digit_share "
    "distinct_share words_per_line dup_line_share double_share"
).split()


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and STATISTICS of the whole text."""
    t = F.col("_text")
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    rows = docs.select(*keep, whole().alias("_text"))
    rows = rows.select(*keep, "_text", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"), lines.alias("_lines"), F.length(F.translate(t, SPACE, "")).alias("_chars"))
    n, lines = F.size("_words"), F.size("_lines")
    made = {
        "words": F.log1p(n.cast("double")),
        "chars_per_word": per(F.col("_chars"), n),
        "symbol_share": per(count("#*$%&<>"), F.col("_chars")),
        "bang_share": per(count("!"), F.col("_chars")),
        "bar_share": per(count("|"), F.col("_chars")),
        "mark_share": per(count(".,;:"), F.col("_chars")),
        "upper_share": per(F.regexp_count(t, F.lit(r"\p{Lu}")), F.col("_chars")),
        "digit_share": per(count("0123456789"), F.col("_chars")),
        "distinct_share": per(F.size(F.array_distinct("_words")), n),
        "words_per_line": F.log1p(per(n, lines)),
        "dup_line_share": per(lines - F.size(F.array_distinct("_lines")), lines),
        "double_share": per(F.size(F.filter(F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", F.lit(2), F.greatest(n, F.lit(1))).alias("b")), lambda p: p["a"] == p["b"])), n),
    }
    return rows.select(*keep, *(c.cast("double").alias(k) for k, c in made.items()))


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, cut)


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> set[Rule]:
    """The paths of boosted trees with logistic loss."""
    order = np.argsort(x, axis=0, kind="stable")
    cuts = []
    for f, o in enumerate(order.T):  # quantiles of the weighted values
        upto = np.cumsum(weight[o])
        cuts.append(np.unique(x[o[np.searchsorted(upto, upto[-1] * np.linspace(0, 1, BINS + 1)[1:-1])], f]))
    binned = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)]  # bin > k means value > cut k
    mean = float(y @ weight / weight.sum())
    score, rules = np.full(len(y), math.log((mean + 1e-3) / (1 - mean + 1e-3))), set()

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, path: Rule, out: np.ndarray) -> None:
        best, total = (1e-3, None, None), weight[rows].sum()
        if len(path) < DEPTH and total >= 20:
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, c in enumerate(cuts):
                b = binned[f][rows]
                gl, hl, n = (np.cumsum(np.bincount(b, v[rows], len(c) + 1))[:-1] for v in (g, h, weight))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < 5) | (total - n < 5)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            out[rows] = 0.3 * -g[rows].sum() / (h[rows].sum() + 1)
            return
        _, f, k = best
        above = binned[f][rows] > k
        for side in (False, True):
            longer = tuple(sorted((*path, (f, side, float(cuts[f][k])))))
            rules.add(longer)
            split(rows[above == side], g, h, longer, out)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        split(np.arange(len(y)), (p - y) * weight, p * (1 - p) * weight, (), step)
        score += step
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, weight: np.ndarray, steps: int = 500) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty by accelerated proximal steps; the intercept is free."""
    n = weight.sum()
    full = np.hstack([np.ones((len(y), 1)), m])
    v = np.ones(full.shape[1])
    for _ in range(20):  # the largest curvature
        v = full.T @ (weight * (full @ v))
        top = np.linalg.norm(v)
        v /= top
    rate = 4 * n / top
    w = z = np.zeros(full.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
        new = z - rate * (full.T @ (weight * (p - y))) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        z, w = new + (k / (k + 3)) * (new - w), new
    return float(w[0]), w[1:]


class Ensemble:
    """An intercept and weighted rules."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, weight: np.ndarray | None = None):
        weight = np.ones(len(y)) if weight is None else weight
        self.rules: list[tuple[Rule, float]] = []
        ones, total = float(y @ weight), float(weight.sum())
        share = (ones + 0.5) / (total + 1)
        self.intercept = math.log(share / (1 - share))
        if 0 < ones < total:
            rules = sorted(grow(x, y, weight))
            if rules:
                m = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
                self.intercept, w = lasso(m, y, penalty, weight)
                self.rules = [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6]

    def column(self) -> Column:
        """The score, of the columns STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            each = None
            for f, above, cut in rule:
                c = F.col(STATISTICS[f]) > F.lit(cut) if above else F.col(STATISTICS[f]) <= F.lit(cut)
                each = c if each is None else each & c
            total = total + F.when(each, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(stats: DataFrame, labels: DataFrame) -> Ensemble:
    """``stats``: doc_id and STATISTICS; ``labels``: doc_id and quality."""
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", F.col("quality").cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    good = settle(good.withColumn("_h", F.xxhash64("doc_id", "_y")))
    # the first of n hashes lie below a share of the range that n tells, so that tasks hand on few rows however many have labels
    n = good.count()
    good = good.where((F.col("_h").cast("double") / F.lit(2.0**64) + 0.5) * n <= 2 * SAMPLE)
    examples = stats.join(good, "doc_id").groupBy("_h", "doc_id", "_y", *STATISTICS).agg(F.sum("_n").alias("_n"))
    got = examples.orderBy("_h", "doc_id", "_y", *STATISTICS).limit(SAMPLE).toPandas()
    return Ensemble(got[STATISTICS].to_numpy(float), got["_y"].to_numpy(float), weight=got["_n"].to_numpy(float))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    stats = settle(statistics(documents(spark, folder), "doc_id"))
    held_out = remainder("doc_id", 5) == 0
    model = fit(stats.where(~held_out), spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet"))
    rows = stats.select("doc_id", held_out.alias("held_out"), model.column().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict = {}
