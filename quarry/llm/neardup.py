"""Near duplicates by order MinHash and banded alignment.

Texts become words (letters and digits, folded to lower case) and these become shingles of
``SHINGLE`` words, each labelled with its occurrence. Each of ``SKETCHES`` hash orders picks
the two smallest labelled shingles and keeps them in text order; the pair is one entry of the
sketch. Texts that differ by few edits share entries. Candidates agree in one entry, in
``ALIKE`` of ``MINIMA`` least hashes of their words, and in size as far as the similarity needs. They are aligned:
the longest common subsequence of their words, within the band that the
similarity permits. Two texts are similar if the aligned words are ``SIMILAR`` or more of all
words of both. (Any two texts that share 0.8 of their shingles in order are; texts of 400 words
with 40 of them replaced share 0.42 of their shingles only, and are similar all the same.)

Texts with equal words are one node. In each bucket, the nodes that share an entry, every
node is compared with one of them, the hub, the first by a hash that differs between rounds
and between ``ORDERS`` sets of entries; those not linked with it meet ``HUBS`` - 1 more. So large
groups of near copies become classes by comparisons in proportion to their nodes. Of two similar
nodes a hub may hold one only, or neither. Hence all pairs of nodes that share a bucket and aren't
of one class after that are candidates too: members of buckets that hold several classes are dealt
to blocks of about ``BLOCK``, which meet in pairs, and what agrees in least hashes and size is
aligned. So no candidate pair of two classes is left out, and nothing is capped; pairs within a
class change nothing and aren't compared. In a bucket of many texts that aren't near (of a
passage that they share) the least hashes of all pairs of similar size are compared, 32 bytes each.

Links make classes by alternating stars, written to the shared folder each round.

An entry agrees with a chance of about the square of the share of common shingles. At a
share of 0.8, a pair agrees in none of 20 with a chance of 1e-9, at 0.42 of 0.02, at 0.38, as of texts
at 0.8 whose edits are spread evenly, of 0.04. Of the least hashes a pair at 0.8 has fewer than
18 of 32 in common with a chance of 2e-4. test_round3.py holds recall against plants.

Defined cases: texts with no letter or digit use the words between white space; a null text,
or one of no words, is a class of its own; the class id is the smallest id of its documents;
texts of fewer than five words are one shingle, so that only equal ones meet; hash collisions
of shingles only make candidates; of equal hub hashes the smaller node leads; very long texts
are aligned within the band, in memory of about its width for each frequent word; equal ids and
repeated rows are separate documents of one class if their texts are near, and of rows equal in
id and text one stays when duplicates are dropped; an empty table gives an empty result;
further columns are kept by drop_duplicates and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, aside, discard, documents, lean, settle, whole

SHINGLE, SKETCHES, SIMILAR, ORDERS = 5, 20, 0.8, 4
HUBS, BLOCK, LIST = 3, 256, 4096  # hubs that a bucket is compared with before its members meet in pairs; members of a bucket that meet at once; pairs aligned at once
MINIMA, ALIKE = 32, 18  # least hashes of a text's words, a byte each; how many of them two texts to align have in common
FREQUENT = 64  # words that stand so often in a text are aligned by bit masks, others place by place
_FOLDED = re.compile(r"[^\W_]+")
_ODD, _ODD_WORDS = ((np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1) for seed, n in ((20_11, SKETCHES), (20_12, MINIMA)))


def words_of(text: str) -> list[str]:
    return _FOLDED.findall(text.lower()) or text.split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Numbers(dict):
    """Hashes of words."""

    def __missing__(self, word: str) -> int:
        out = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return out


class Shingler:
    def __init__(self, most: int = 100_000):
        self.numbers, self.most = _Numbers(), most

    def words(self, words: list[str]) -> np.ndarray:
        """The hashes of the words."""
        if len(self.numbers) > self.most:
            self.numbers.clear()
        return np.fromiter(map(self.numbers.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def shingles(v: np.ndarray) -> np.ndarray:
        """The hashes of the shingles, in text order, of hashes of words."""
        k = min(len(v), SHINGLE)
        n = len(v) - k + 1 if k else 0
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + v[j : j + n])
        return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence number mixed in."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.ones(len(t), bool)
    first[1:] = t[1:] != t[:-1]
    if first.all():
        return s
    place = np.arange(len(t))
    number = np.empty(len(t), np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return np.where(number > 0, _mix(s + number * np.uint64(0xC2B2AE3D27D4EB4F)), s)


def sketch(s: np.ndarray) -> np.ndarray:
    """For each hash order the hash of its two smallest labelled shingles, taken in text order."""
    s = labelled(s)
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, (1 << 20) // len(s))
    for at in range(0, SKETCHES, step):
        h = _mix((s[None, :] + _ODD[at : at + step, None]) * _ODD[at : at + step, None])
        rows = np.arange(len(h))
        one = h.argmin(axis=1)
        h[rows, one] = np.uint64(2**64 - 1)
        two = h.argmin(axis=1)
        out[at : at + step] = s[np.minimum(one, two)] * np.uint64(0x9E3779B97F4A7C15) + s[np.maximum(one, two)]
    return _mix(out)


def minima(v: np.ndarray) -> np.ndarray:
    """For each of some hash orders the least of the hashes of the words, labelled with their occurrence, less all but a byte."""
    v, out = labelled(v), np.empty(MINIMA, np.uint64)
    step = max(1, (1 << 20) // len(v))
    for at in range(0, MINIMA, step):
        h = _mix((v[None, :] ^ _ODD_WORDS[at : at + step, None]) * _ODD_WORDS[at : at + step, None])
        out[at : at + step] = h.min(axis=1)
    return _mix(out).astype(np.uint8).view(np.int8)


def common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose places differ by ``band`` at most, by bits of a long integer."""
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    tail = int(differ[0]) if len(differ) else k
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    counts, places, masks = Counter(a.tolist()), defaultdict(list), {}
    often = {x for x, n in counts.items() if n >= FREQUENT}
    for i, x in enumerate(a.tolist()):
        if x not in often:
            places[x].append(i)
    low, high, row, found, step = 0, 0, 0, 0, 2 * band + 64  # row: a bit for each place from low to high, 0 where the length grows
    for i, x in enumerate(b.tolist()):
        if high < min(len(a), i + band + 1):
            more = min(len(a), i + band + 1 + step) - high
            row |= ((1 << more) - 1) << (high - low)
            for p, y in enumerate(a[high : high + more].tolist(), high - low) if often else ():
                if y in often:
                    masks[y] = masks.get(y, 0) | 1 << p
            high += more
        if i - band - low > step:  # places behind the band don't change any more
            gone = min(i - band, high) - low
            found += gone - (row & ((1 << gone) - 1)).bit_count()
            row >>= gone
            low += gone
            masks = {y: m >> gone for y, m in masks.items()}
        if x in often:
            match = masks.get(x, 0)
            if i - band > low:
                match = match >> (i - band - low) << (i - band - low)
            match &= (1 << max(0, i + band + 1 - low)) - 1
        else:
            match = 0
            for p in places.get(x, ()):
                if abs(p - i) <= band:
                    match |= 1 << (p - low)
        if match:
            up = row & match
            row = ((row + up) | (row - up)) & ((1 << (high - low)) - 1)
    return head + tail + found + high - low - row.bit_count()


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words of both, whatever their order."""
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Aligned words over all words of both; 0 if it can't reach ``least``."""
    small, large = sorted((len(a), len(b)))
    need = least / (1 + least) * (small + large)
    if small < least * large or _shared(a, b) < need - 1e-9:
        return 0.0
    n = common(a, b, int(large - need) + 1)
    return n / (small + large - n)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, tx, node, n, sketch, minima): tx stands for the text as it is, node for its words (null: no words), n is their number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("tx"), whole().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Shingler()
        for batch in batches:
            nodes, sizes, made, least = [], [], [], []
            for t in batch.column(2):
                w = words_of(t.as_py())
                sizes.append(len(w))
                if w:
                    nodes.append(int.from_bytes(hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                    v = hashed.words(w)
                    made.append(sketch(hashed.shingles(v)).view(np.int64))
                    least.append(minima(v))
                else:
                    nodes.append(None)
                    made.append(None)
                    least.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(made, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int8()))],
                ["doc_id", "tx", "node", "n", "sketch", "minima"],
            )

    return rows.mapInArrow(lean(run), "doc_id long, tx long, node long, n int, sketch array<long>, minima array<tinyint>")


def hashed_words(texts: DataFrame) -> DataFrame:
    """(node, words): the words' hashes as bytes. ``texts``: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Shingler()
        for batch in batches:
            made = [hashed.words(words_of(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["node", "words"])

    return texts.select("node", "text").mapInArrow(lean(run), "node long, words binary")


def aligned(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b, near): whether they are similar. ``words``: (node, words), from hashed_words()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column(i)] for i in (2, 3))
            near = [similarity(v, w) >= SIMILAR for v, w in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["a", "b", "near"])

    rows = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    rows = rows.join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb")
    return rows.mapInArrow(lean(run), "a long, b long, near boolean")


def _mixed(shared: DataFrame, nodes: DataFrame, roots: DataFrame, words: DataFrame) -> DataFrame:
    """The similar pairs (a, b) of nodes of different roots that share a bucket. ``shared``: (band, key, node), ``roots``: (node, root).

    Members of a bucket are dealt to blocks, by size and a hash, and blocks meet in pairs, so that no task holds a bucket. A pair is
    taken in the first bucket that it shares. Pairs to align travel as lists, with the words of each of their nodes once.
    """
    spark = nodes.sparkSession
    named = settle(shared.join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root")))
    mixed = named.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    mixed = settle(mixed.select(F.col("band").alias("_band"), F.col("key").alias("_key"), "size"))
    rows = named.join(mixed, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).drop("_band", "_key").join(nodes.select("node", "n", "sketch", "minima"), "node")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))
    rows = rows.withColumns({"bin": F.floor(F.log("n") / math.log(1 / SIMILAR)), "block": block})  # similar sizes are in equal bins or neighbours
    fields = ("node", "root", "n", "sketch", "minima")
    blocks = rows.groupBy("band", "key", "bin", "block").agg(F.collect_list(F.struct(*fields)).alias("of"))
    blocks = settle(blocks.select("band", "key", "bin", "block", F.monotonically_increasing_id().alias("at"), *(F.col(f"of.{c}") for c in fields[:3]), *(F.flatten(f"of.{c}").alias(c) for c in fields[3:])))
    one, two = (blocks.select("band", "key", *(F.col(c).alias(f"{c}{i}") for c in ("bin", "block", "at"))) for i in (1, 2))
    meet = one.join(two, ["band", "key"]).where("bin2 = bin1 + 1 OR bin2 = bin1 AND block2 >= block1").select("band", "at1", "at2")
    for i in (1, 2):
        meet = meet.join(blocks.select(*(F.col(c).alias(f"{c}{i}") for c in ("at", *fields))), f"at{i}")
    meet = meet.select("band", *(f"{c}{i}" for i in (1, 2) for c in fields))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for at, band in enumerate(batch.column(0).to_pylist()):
                x, r, n, e, m, y, s, k, f, q = (batch.column(i)[at].values.to_numpy() for i in range(1, 11))
                e, f, m, q = e.reshape(-1, SKETCHES), f.reshape(-1, SKETCHES), m.reshape(-1, MINIMA), q.reshape(-1, MINIMA)
                same, left, right = x[0] == y[0] and len(x) == len(y) and (x == y).all(), [], []
                for i in range(len(x)):
                    fit = np.flatnonzero((r[i] != s) & (np.minimum(n[i], k) >= SIMILAR * np.maximum(n[i], k)))
                    fit = fit[fit > i] if same else fit
                    fit = fit[(q[fit] == m[i]).sum(axis=1) >= ALIKE]
                    fit = fit[~(f[fit, :band] == e[i, :band]).any(axis=1)]
                    left.append(np.full(len(fit), x[i]))
                    right.append(y[fit])
                left, right = np.concatenate(left), np.concatenate(right)
                lists += [(left[j : j + LIST], right[j : j + LIST]) for j in range(0, len(left), LIST)]
            columns = [pa.array([v[i] for v in lists], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    lists = settle(meet.mapInArrow(lean(find), "a array<long>, b array<long>").withColumn("at", F.monotonically_increasing_id()))
    discard(spark, named, mixed, blocks, sweep=False)
    need = lists.select(F.col("at").alias("_at"), F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).join(words, "node")
    need = need.groupBy("_at").agg(F.collect_list(F.struct("node", "words")).alias("of"))
    ready = lists.join(need, F.col("at") == F.col("_at")).select("a", "b", F.col("of.node").alias("node"), F.col("of.words").alias("words"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for at in range(batch.num_rows):
                a, b, node = (batch.column(i)[at].values.to_pylist() for i in range(3))
                held = {x: np.frombuffer(w.as_buffer(), np.uint64) for x, w in zip(node, batch.column(3)[at].values)}
                near += [(min(x, y), max(x, y)) for x, y in zip(a, b) if similarity(held[x], held[y]) >= SIMILAR]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in near], pa.int64()) for i in (0, 1)], ["a", "b"])

    pairs = settle(ready.mapInArrow(lean(align), "a long, b long").distinct())
    discard(spark, lists, sweep=False)
    return pairs


def links(nodes: DataFrame, words_for) -> tuple[DataFrame, DataFrame]:
    """The similar pairs (a, b) that make the classes, and (node, root) of their nodes. ``nodes``: (node, n, sketch, minima), unique; ``words_for`` gives (node, words) for a table of nodes."""
    spark = nodes.sparkSession
    members = nodes.select("node", F.posexplode("sketch").alias("band", "key"))
    same = (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))
    alike = F.size(F.filter(F.zip_with("minima", "_minima", lambda x, y: x == y), lambda x: x)) >= ALIKE
    words, shared, first, tried, kept, last = None, None, [], None, [], []
    for nth in range(HUBS):
        order = F.xxhash64("node", F.lit(nth), F.col("band") % ORDERS).alias("order")
        hubs = members.groupBy("band", "key").agg(F.min(F.struct(order, "node")).alias("hub"), F.count("*").alias("size")).where("size > 1")
        # written, so that nothing but exchanges stands below the join, which can then split large buckets
        hubs = settle(hubs.select(F.col("band").alias("_band"), F.col("key").alias("_key"), F.col("hub.node").alias("hub")))
        rows = members.join(hubs, same).where("node <> hub").select("band", "key", "node", "hub")
        rows = rows.join(nodes.select("node", F.col("n").alias("n_own"), "minima"), "node")
        rows = rows.join(nodes.select(F.col("node").alias("hub"), F.col("n").alias("n_other"), F.col("minima").alias("_minima")), "hub")
        fit = (F.least("n_own", "n_other") >= SIMILAR * F.greatest("n_own", "n_other")) & alike
        rows = settle(rows.select("band", "key", "node", F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), fit.alias("fit")))
        discard(spark, *last, sweep=nth < 2)  # later rounds shuffle little
        pairs = rows.where("fit").select("a", "b").distinct()
        if words is None:  # later rounds meet no other nodes
            words = words_for(rows.select(F.explode(F.array("a", "b")).alias("node")).distinct())
            shared, first = rows.select("band", "key", "node").union(hubs.select("_band", "_key", "hub")), [rows, hubs]
            new = settle(aligned(pairs, words))
            last, tried = [], new
        else:
            asked = settle(pairs.join(tried, ["a", "b"], "left_anti"))
            new = settle(aligned(asked, words))
            last, tried = [rows, hubs, asked], tried.union(new)
        kept.append(new)
        members = settle(rows.join(tried.where("near"), ["a", "b"], "left_anti").select("node", "band", "key"))
        last.append(members)
        if members.isEmpty():
            break
    discard(spark, *last, sweep=False)
    # what share a bucket and aren't of one class yet are compared pair by pair
    roots = components(tried.where("near").select("a", "b"))
    more = _mixed(shared, nodes, roots, words)
    if not more.isEmpty():  # classes that these join
        by = roots.select(F.col("node").alias("_of"), "root")
        over = more
        for c in ("a", "b"):
            over = over.join(by, F.col(c) == F.col("_of"), "left").withColumn(c, F.coalesce("root", c)).drop("_of", "root")
        tops = components(over)
        selves = more.select(F.explode(F.array("a", "b")).alias("node")).union(roots.select("root")).select("node", F.col("node").alias("root"))
        known = roots.union(selves).groupBy("node").agg(F.min("root").alias("root"))
        joined = known.join(tops.select(F.col("node").alias("_of"), F.col("root").alias("_top")), F.col("root") == F.col("_of"), "left")
        joined = settle(joined.select("node", F.coalesce("_top", "root").alias("root")))
        discard(spark, roots, tops, sweep=False)
        roots = joined
    out = settle(reduce(DataFrame.union, kept).where("near").select("a", "b").union(more))
    discard(spark, words, more, *first, *kept)
    return out, roots


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes in ``edges`` (a, b), by alternating large and small stars; roots are the smallest nodes."""
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(down, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select(F.col("_u"), F.col("m")))
        old, edges = edges, settle(small.where("u <> v").distinct())
        discard(edges.sparkSession, old, sweep=False)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._settled_at = edges._settled_at
            return out
        last = now


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, tx, class_id, n_links, keep) of each document.

    n_links counts the verified links of its words with other ones, of those that make the classes; keep marks the rows equal in
    doc_id and tx of which one stands for the class.
    """
    rows = settle(sketched(docs))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "tx")).alias("first"), F.min("n").alias("n"), F.first("sketch").alias("sketch"), F.first("minima").alias("minima"))
    nodes = settle(nodes)

    def words_for(some: DataFrame) -> DataFrame:
        wanted = some.join(nodes, "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.tx").alias("_tx"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")))
        # rows equal in id and text are one node
        return settle(hashed_words(texts.where(F.xxhash64("text") == F.col("_tx")).select("node", "text").dropDuplicates(["node"])))

    pairs, roots = links(nodes.select("node", "n", "sketch", "minima"), words_for)
    number = pairs.select(F.explode(F.array("a", "b")).alias("_with")).groupBy("_with").agg(F.count("*").alias("n_links"))
    of = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    keeper = of.groupBy("root").agg(F.min("first").alias("keeper"), F.min("first.doc_id").alias("class_id"))
    keeper = settle(keeper)  # as with the hubs: the join can then split a large class
    of = of.join(keeper, "root").join(number, F.col("node") == F.col("_with"), "left").select(F.col("node").alias("_n"), "class_id", "keeper", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of = settle(of)  # likewise for the rows of a text with many copies
    out = rows.select("doc_id", "tx", "node").join(of, F.col("node") == F.col("_n"), "left")
    mine = F.col("node").isNull() | F.struct("doc_id", "tx").eqNullSafe(F.col("keeper"))
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    out = settle(out.select("doc_id", "tx", class_id, F.coalesce("n_links", F.lit(0)).alias("n_links"), mine.alias("keep")))
    discard(docs.sparkSession, rows, nodes, pairs, roots, keeper, of)
    return out


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class."""
    docs, back = aside(docs, "doc_id", "text")
    of = classes(docs)
    keep = of.where("keep").select(F.col("doc_id").alias("_id"), F.col("tx").alias("_tx")).distinct()
    rows = docs.withColumn("_tx0", F.xxhash64(whole())).withColumn("_id0", F.col("doc_id").cast("long"))
    empty = F.length(F.translate(whole(), SPACE, "")) == 0  # of classes of their own, however many rows are equal
    one = rows.where(~empty).join(keep, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_tx0") == F.col("_tx")), "left_semi")
    return one.dropDuplicates(["_id0", "_tx0"]).union(rows.where(empty)).select(*back())


def op6_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return classes(documents(spark, folder).select("doc_id", "text")).select("doc_id", "class_id", "n_links")


QUERIES = {"op6_neardup": op6_neardup}
ORACLES: dict = {}
