"""Language identification, family first.

A softmax model over hashed trigrams of letters' bytes predicts the language family; within
the family, one-versus-one linear support vector machines (squared hinge) vote. The score is
the family's probability times the mean, over the winner's pairs, of the probability that a
logistic fit gives its margin.

Models are fitted on at most ``SAMPLE`` rows, the first of each of the ``LANGUAGES`` most
frequent languages by a hash of id and text, ``EACH`` at most; these bounds and the number of
buckets bound the driver's memory and the broadcasts. Rows equal in language, id and text are
one example. Counts are taken of whole texts and sent as the buckets that aren't empty.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every
text if there is nothing to learn from; one language alone is predicted with score 1; codes
that the family table lacks form the family ``other``; equal hashes are one example; of equally
likely languages the first by code is predicted; repeated rows are predicted alike; a text of
any length makes one vector of fixed size; an empty table gives an empty result; columns
lang_pred and score are replaced, others kept.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import aside, discard, documents, remainder, settle, whole

BUCKETS, EACH, SAMPLE, LANGUAGES = 1 << 13, 600, 6000, 1000

# Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi bn ur pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "celtic": "ga cy gd br",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for b in range(128):
        if not chr(b).isalpha():
            t[b] = 32
    return t


_BYTES = _table()


def trigrams(text: str) -> np.ndarray:
    """Square roots of the trigrams' shares by bucket: a vector of length 1."""
    b = _BYTES[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = b[keep]
    if len(b) < 3:
        return np.zeros(BUCKETS, np.float32)
    h = b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)
    h = (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)
    return np.sqrt(np.bincount(h, minlength=BUCKETS) / len(h)).astype(np.float32)


def _descend(gradient, shape, rate: float, steps: int) -> np.ndarray:
    """Accelerated gradient descent."""
    w = z = np.zeros(shape, np.float32)
    for k in range(steps):
        new = z - rate * gradient(z)
        z, w = new + (k / (k + 3)) * (new - w), new
    return w


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, x1: np.ndarray, langs: list[str]):
        """``x1``: vectors with a last column of ones."""
        self.langs = sorted(set(langs))
        y = np.array(langs)
        self.families = sorted({FAMILY.get(c, "other") for c in self.langs})
        self.members = {f: [c for c in self.langs if FAMILY.get(c, "other") == f] for f in self.families}
        fam = np.array([self.families.index(FAMILY.get(c, "other")) for c in langs])
        self.family = self._family(x1, fam)
        self.pairs = {f: [(a, b, *self._pair(x1[(y == a) | (y == b)], y[(y == a) | (y == b)] == a)) for a, b in itertools.combinations(m, 2)] for f, m in self.members.items()}

    def _family(self, x: np.ndarray, fam: np.ndarray) -> np.ndarray:
        k = len(self.families)
        want = np.eye(k, dtype=np.float32)[fam]
        weight = (1 / np.maximum(1, want.sum(axis=0)))[fam][:, None] / k
        grad = lambda w: x.T @ (weight * (_softmax(x @ w) - want)) + 1e-5 * w
        return _descend(grad, (x.shape[1], k), 1.0, 300 if k > 1 else 0)

    @staticmethod
    def _pair(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float, float]:
        s = np.where(first, 1.0, -1.0).astype(np.float32)
        weight = np.where(first, 0.5 / max(1, first.sum()), 0.5 / max(1, (~first).sum())).astype(np.float32)
        grad = lambda w: x.T @ (-2 * weight * s * np.maximum(0, 1 - s * (x @ w))) + 1e-4 * w
        w = _descend(grad, x.shape[1], 0.25, 300)
        margin = x @ w
        a = b = 0.0
        for _ in range(200):  # the logistic fit of the margins
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            d = weight * (p - (s > 0) * 0.999 - (s < 0) * 0.001)
            a, b = a - 4 * float(d @ margin), b - 4 * float(d.sum())
        return w, a, b

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = _with_one(x)
        p = _softmax(x @ self.family)
        best = p.argmax(axis=1)
        out, score = [""] * len(x), p.max(axis=1).astype(np.float64)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(best == i)
            names = self.members[f]
            if not len(rows):
                continue
            votes, belief = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for a, b, w, slope, shift in self.pairs[f]:
                q = 1 / (1 + np.exp(-np.clip(slope * (x[rows] @ w) + shift, -30, 30)))
                for name, r in ((a, q), (b, 1 - q)):
                    votes[:, names.index(name)] += r > 0.5
                    belief[:, names.index(name)] += r
            win = (votes + belief / (len(names) + 1)).argmax(axis=1)
            if len(names) > 1:
                score[rows] *= belief[np.arange(len(rows)), win] / (len(names) - 1)
            for r, k in zip(rows, win):
                out[r] = names[k]
        return out, score


def _sparse(text: pd.Series) -> pd.Series:
    """Buckets that aren't empty, two bytes each, and then their values, four bytes each."""

    def one(t: str) -> bytes:
        v = trigrams(t)
        at = np.flatnonzero(v)
        return at.astype("<u2").tobytes() + v[at].astype("<f4").tobytes()

    return text.map(one)


def sample(docs: DataFrame) -> DataFrame:
    """(lang, key) of the rows to learn from, at most SAMPLE; the key is a hash of id and text."""
    keys = docs.where(F.col("lang").isNotNull() & whole().rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id", "text").alias("key")).distinct()
    keys = settle(keys)
    counts = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select(F.col("lang").alias("_lang"), "count")
    # the first of a language's n hashes lie below a share of the range that n tells, so few rows are ranked however large a language is
    share = F.col("key").cast("double") / F.lit(2.0**64) + 0.5
    few = keys.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).where(share * F.col("count") <= 4 * EACH)
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("_n") <= EACH)
    out = settle(few.orderBy("_n", "lang").limit(SAMPLE).select(F.col("lang").alias("_lang"), F.col("key").alias("_key")))
    discard(docs.sparkSession, keys)
    return out


def fit(docs: DataFrame) -> Model | None:
    """From a bounded sample of ``docs`` (doc_id, text, lang); None if no row has a language and a letter."""
    some = sample(docs)
    rows = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    rows = rows.join(F.broadcast(some), (F.col("lang") == F.col("_lang")) & (F.col("key") == F.col("_key")), "left_semi")  # at most SAMPLE rows
    rows = rows.dropDuplicates(["lang", "key"]).select("lang", "key", F.pandas_udf(_sparse, "binary")("text").alias("x"))
    got = sorted(tuple(r) for r in rows.toLocalIterator())
    discard(docs.sparkSession, some)
    if not got:
        return None
    x1 = np.zeros((len(got), BUCKETS + 1), np.float32)
    x1[:, -1] = 1
    for row, (_, _, x) in zip(x1, got):
        n = len(x) // 6
        row[np.frombuffer(x, "<u2", n)] = np.frombuffer(x, "<f4", n, 2 * n)
    return Model(x1, [r[0] for r in got])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    docs, back = aside(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(text: pd.Series) -> pd.DataFrame:
        import regex

        letter, m = regex.compile(r"\p{L}"), shared.value
        lang, score = np.array(["und"] * len(text), object), np.zeros(len(text))
        has = np.flatnonzero([m is not None and t is not None and letter.search(t) is not None for t in text])
        for at in range(0, len(has), 256):
            some = has[at : at + 256]
            lang[some], score[some] = m.predict(np.stack([trigrams(text.iloc[i]) for i in some]))
        return pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1)})

    udf = F.pandas_udf(predict, "lang_pred string, score double")
    names = ("lang_pred", "score")
    return docs.withColumn("_found", udf("text")).select(*back(*names), *(F.col(f"_found.{k}").alias(k) for k in names))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = remainder("doc_id", 3) == 1
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    rows = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
ORACLES: dict = {}
