"""Exact top-k by inner product, with MaxScore.

Components become integers. A term is a dimension; its posting list is the column of the
vectors' components, nought where a vector lacks the term.

Vectors are dealt to shards and queries to blocks, and each shard meets each block in one task
at a time, which builds the shard's columns with the largest and smallest component of each. A query's
bound for a term is its component times whichever of these gives more, nought at least. A first
threshold comes from the extreme entries of its strongest terms, scored in full. Terms are put
in order of their bounds; the weakest, as long as their bounds together stay below ``SHARE`` of the threshold,
are non-essential: no vector can compete by these alone. The essential postings are traversed,
for some queries at once by a matrix product. Vectors whose score so far and the bounds of
the rest reach the threshold are probed in the non-essential terms, the strongest first, and
leave as soon as they can't reach it. The shards' best are merged, by Spark's own limit within
each task before the shuffle. (Where all vectors have all terms, as embeddings do, a larger share of
the threshold would traverse fewer postings and probe many more vectors.)

So a task holds a shard and a block, whose sizes are bounded, and each moves once for each of
the others' parts.

Defined cases: a vector that is null or holds a null, an infinity or no number takes no part, as
query or candidate; components that lack at the end of a vector shorter than others count as 0; components beyond
the range of a long count as its ends, and so do scores; equal scores go by id, null ids last, and of
equal ids any row may come first; a row with a null id is no query; a repeated id makes separate
queries and candidates, each leaving out its own row only; equal vectors all count; fewer
candidates than k all come; without queries or candidates there are no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import settle
from quarry.llm.whitening import finite

SCALE, K = 256, 5
SHARD_ENTRIES, BLOCK_ENTRIES = 1 << 22, 1 << 19  # no more components a shard or a block
SHARDS, LEAST_ROWS = 16, 1 << 12  # at least so many shards, as long as they have so many rows
SEEDS, PROBED, AT_ONCE = 3, 4, 64  # terms that give the first threshold; terms probed, and queries that traverse, at once
SHARE = 0.25
EXACT, LARGEST = 1 << 53, (1 << 63) - 1  # below it, sums of integers are exact in doubles; the end of longs


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, x) of the vectors that take part, written: row is a number of its own for each."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.where(finite(F.col("embedding")))
    return settle(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as rows of ``dims``."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


class Shard:
    """Columns of components, with their extremes and the places of these."""

    def __init__(self, rows: np.ndarray, ids: list[int | None], x: np.ndarray, k: int):
        self.rows, self.x, self.k = rows, x, k
        self.order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
        self.rank = np.empty(len(ids), np.int64)
        self.rank[self.order] = np.arange(len(ids))
        self.high, self.low = x.max(axis=0, initial=0), x.min(axis=0, initial=0)
        by = np.argsort(x, axis=0, kind="stable")
        self.last, self.first = by[::-1][: k + 1], by[: k + 1]

    def threshold(self, q: np.ndarray, seeds: np.ndarray, own: int):
        """What the k-th of some vectors scores, which is no more than the k-th of all. None if they are too few, or any score will do."""
        seeds = seeds[self.rows[seeds] != own]
        if len(seeds) < self.k:
            return None
        least = min(np.sort(self.x[seeds] @ q)[-self.k], LARGEST)
        return None if least <= -LARGEST else least

    def search(self, queries: np.ndarray, own: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """(place, score) of the k best for each query, whose own row is left out."""
        for i in range(0, len(queries), AT_ONCE):
            some = queries[i : i + AT_ONCE]
            bounds = np.maximum(np.where(some > 0, some * self.high, some * self.low), 0)
            order = np.argsort(bounds, axis=1, kind="stable")
            upto = np.cumsum(np.take_along_axis(bounds, order, axis=1), axis=1)
            strong = [np.unique(np.where(q[o] > 0, self.last[:, o], self.first[:, o])) for q, o in zip(some, order[:, -SEEDS:])]
            least = [self.threshold(q, s, r) for q, s, r in zip(some, strong, own[i : i + AT_ONCE])]
            split = [0 if t is None else int((u < SHARE * t).sum()) for u, t in zip(upto, least)]
            essential = some.copy()
            for e, o, n in zip(essential, order, split):
                e[o[:n]] = 0
            for q, r, o, u, n, t, score in zip(some, own[i : i + AT_ONCE], order, upto, split, least, essential @ self.x.T):
                yield self.best(q, r, o[:n], u, t, score)

    def best(self, q: np.ndarray, own: int, others: np.ndarray, upto: np.ndarray, least, score: np.ndarray) -> list[tuple[int, int]]:
        """Of vectors with their score in the essential terms; ``others``: the rest, the weakest first, whose bounds add up as in ``upto``."""
        left = len(others)
        if least is not None:  # what leads so far gives a better threshold
            n = min(self.k + 1, len(score))
            leading = self.threshold(q, np.argpartition(score, -n)[-n:], own)
            least = least if leading is None else max(least, leading)
        at = np.arange(len(score)) if least is None else np.flatnonzero(score + (upto[left - 1] if left else 0) >= least)
        score = score[at]
        while left:
            left, terms = max(0, left - PROBED), others[max(0, left - PROBED) : left]
            score = score + self.x[at[:, None], terms] @ q[terms]
            if least is not None:
                stay = score + (upto[left - 1] if left else 0) >= least
                at, score = at[stay], score[stay]
        mine = self.rows[at] != own
        at, score = at[mine], np.clip(score[mine], -LARGEST - 1, LARGEST)
        if len(at) > self.k:
            stay = score >= np.sort(score)[-self.k]
            at, score = at[stay], score[stay]
        first = sorted(zip(np.negative(score).tolist(), self.rank[at].tolist()))[: self.k]
        return [(int(self.order[r]), -int(s)) for s, r in first]


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each of ``queries``, both (row, vec_id, x), whose rows are numbered in common."""
    n, longest = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    n_queries, longest = queries.count(), max(1, longest or 0)
    shard_rows = max(1, min(SHARD_ENTRIES // longest, max(LEAST_ROWS, -(-n // SHARDS))))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // max(1, BLOCK_ENTRIES // longest)))
    number = lambda m: F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")
    deal = lambda m: F.pmod(F.xxhash64("row"), F.lit(m))
    left = vectors.select("row", "vec_id", "x", deal(shards).alias("_s"), F.explode(number(blocks)).alias("_b"))
    right = queries.select("row", "vec_id", "x", deal(blocks).alias("_b"), F.explode(number(shards)).alias("_s"))
    cell = (F.col("_s") * blocks + F.col("_b")).alias("cell")

    def meet(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if docs.num_rows and asked.num_rows:
            dims = max(max((len(v) for v in t.column("x")), default=0) for t in (docs, asked))
            x, q = matrix(docs.column("x"), dims), matrix(asked.column("x"), dims)
            most = [[max(abs(int(c.max())), abs(int(c.min()))) for c in m.T] for m in (x, q)]
            kind = np.float64 if sum(a * b for a, b in zip(*most)) < EXACT else object
            ids = docs.column("vec_id").to_pylist()
            shard = Shard(docs.column("row").to_numpy(), ids, x.astype(kind), k)
            own = asked.column("row").to_numpy()
            for found, mine, name in zip(shard.search(q.astype(kind), own), own.tolist(), asked.column("vec_id").to_pylist()):
                for at, score in found:
                    for c, value in zip(out, (mine, name, ids[at], int(shard.rows[at]), score)):
                        c.append(value)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], ["query", "query_id", "vec_id", "row", "score"])

    found = left.select(cell, "row", "vec_id", "x").groupBy("cell").cogroup(right.select(cell, "row", "vec_id", "x").groupBy("cell"))
    found = found.applyInArrow(meet, "query long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = integers(spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet"))
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op13_topk": op13_topk}
ORACLES = {
    "op13_topk": """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), scored AS (
    SELECT q.row AS query, q.vec_id AS query_id, v.vec_id, v.row, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
    FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.row <> v.row
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query ORDER BY score DESC, vec_id ASC NULLS LAST, row)
QUALIFY row_number() OVER w <= 5
"""
}
