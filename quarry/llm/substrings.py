"""Removal of long repeated byte strings by suffix arrays.

A byte goes if a string of ``SPAN`` bytes that covers it also starts anywhere else, in another
document or the same; strings are judged on the input and never cross documents.

Equal texts are one text with a number of copies: two or more copies repeat each other as a
whole, and one of them stands for all in what follows. So copies cost nothing more.

A suffix array of a whole corpus can't be held by one task, nor all suffixes be shuffled.
Anchors split the work without losing a repeat: of the grams of ``GRAM`` bytes in a string
of SPAN bytes, those with the least hash are anchors, so that equal strings hold equal
anchors at equal places. Anchors whose hash occurs once can't be in a repeat. Of the others

- those whose whole context, all bytes that a string with this anchor can cover, occurs
  twice or more are repeated throughout, as its hash shows;
- of each different context with an equal anchor one comes to a task, which concatenates
  such contexts, less the strings whose hash is alone there, and builds their suffix array in
  two stages: suffixes smaller than their successors are sorted directly, to SPAN bytes, the
  others are induced from these by scans of buckets in ascending order. Adjacent common
  prefixes of SPAN bytes are repeats.

Where more than ``CROWD`` different contexts share an anchor (the edges of a passage that many
documents hold), they are split: the strings that begin furthest before the anchor from the
others, and each half by the bytes that all its strings hold, which equal strings have equal.
Of equal halves one goes on, halves with no other of their kind are done, and crowds are split
again, down to single strings, of which equal ones are one. So no task ever holds a crowd,
and every string is compared by the same suffix arrays.

Counts of anchors and contexts are aggregated before they are shuffled and written before
they are joined, so that the joins on them can be split too.

Texts are told apart by 128 bits of hashes, contexts by 128 bits with their anchor's.

Defined cases: a null text is empty; texts of fewer than SPAN bytes stay whole; repeated rows
repeat each other; of equal contexts the one of the smallest text number and place stands for
all; texts of any length are read in tiles; an empty table gives an empty result; further
columns are kept by cut(), save those it makes; text() of a cut that splits a character drops
the rest of that character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import aside, discard, documents, lean, settle, whole

SPAN, GRAM, CROWD = 200, 64, 2000
GRAMS = SPAN - GRAM + 1
BEFORE = GRAMS - 1
BLOCK, TILE = 1 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_RANDOM = np.random.default_rng(1990).integers(1, 2**63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


def slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each window."""
    done = 1
    while 2 * done <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, hashes of their grams, hashes of their contexts."""
    n = len(data)
    if n > TILE + 4 * SPAN:
        found = []
        for at in range(0, n, TILE):
            low = max(0, at - 2 * SPAN)
            p, a, c = anchors(data[low : at + TILE + 2 * SPAN], powers)
            mine = (p + low >= at) & (p + low < at + TILE)
            found.append((p[mine] + low, a[mine], c[mine]))
        return tuple(np.concatenate(x) for x in zip(*found))
    if n < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[:n], out=sums[1:])
    h = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]) | np.uint64(1)
    least = slide(h, GRAMS, np.minimum)
    edge = np.zeros(BEFORE, np.uint64)
    p = np.flatnonzero(slide(np.concatenate([edge, least, edge]), GRAMS, np.maximum) == h)
    low, high = np.maximum(p - BEFORE, 0), np.minimum(p + SPAN, n)
    c = (sums[high] - sums[low]) * down[low]
    c = _mix(c + (p - low).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (high - p).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return p, h[p], c


def octets(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number."""
    k = data.astype(np.uint64)
    for by in (1, 2, 4):
        k = (k[:-by] << np.uint64(8 * by)) | k[by:]
    return k


def suffix_array(data: np.ndarray, keys: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes. ``keys``: octets() of the data with at least ``depth`` + 8 zeros after it."""
    n = len(data)
    if not n:
        return np.empty(0, np.int32)
    # a suffix is smaller than its successor if the next differing byte is greater; the last suffix isn't
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    differs = np.where(step != 0, np.arange(n, dtype=np.int32), n)
    smaller = step[np.minimum.accumulate(differs[::-1])[::-1]] > 0
    sorted_ = np.flatnonzero(smaller).astype(np.int32)
    sorted_ = sorted_[np.argsort(keys[sorted_], kind="stable")]
    same = keys[sorted_[1:]] == keys[sorted_[:-1]] if len(sorted_) else np.empty(0, bool)
    at = np.arange(len(sorted_), dtype=np.int32)
    group = np.zeros(len(sorted_), np.int32)
    for offset in range(8, depth + 8, 8):
        tied = np.zeros(len(at), bool)
        tied[:-1] |= same
        tied[1:] |= same
        if not tied.any() or offset >= depth:
            break
        new = np.ones(len(at), bool)
        new[1:] = ~same
        group = np.cumsum(new, dtype=np.int32)[tied]
        at = at[tied]
        members = sorted_[at]
        key = keys[members + offset]
        order = np.lexsort((key, group))
        sorted_[at], key = members[order], key[order]
        same = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
    # bucket scans: a suffix greater than its successor comes in its bucket in the order of the successors
    first = data[sorted_]
    heads = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1], np.int32))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int32)
        done = []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(data[before] == c) & ~smaller[before]]
        bucket = np.concatenate([*done, sorted_[heads[c] : heads[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > c) & ~smaller[before]]
        if len(before):
            char = data[before]
            order = np.argsort(char, kind="stable")
            before, char = before[order], char[order]
            cuts = np.flatnonzero(char[1:] != char[:-1]) + 1
            for part, k in zip(np.split(before, cuts), char[np.concatenate([[0], cuts])]):
                waiting[k].append(part)
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, keys: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Of each suffix and the one before it, the length of the common prefix, ``depth`` at most."""
    out = np.zeros(len(order), np.int32)
    open_ = np.arange(1, len(order))
    for offset in range(0, depth, 8):
        differ = keys[order[open_] + offset] ^ keys[order[open_ - 1] + offset]
        equal = differ == 0
        top = differ[~equal]
        alike = (top[:, None] < np.uint64(1) << (np.arange(8, 64, 8, dtype=np.uint64))).sum(axis=1)
        out[open_[~equal]] = np.minimum(depth, offset + alike)
        open_ = open_[equal]
        if not len(open_):
            break
        out[open_] = min(depth, offset + 8)
    return out


def _runs(flags: np.ndarray, *breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of flags; a run also ends where a value of ``breaks`` changes."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    new = np.ones(len(on), bool)
    new[1:] = on[1:] != on[:-1] + 1
    for x in breaks:
        new[1:] |= x[on[1:]] != x[on[:-1]]
    heads = np.flatnonzero(new)
    return on[heads], on[np.append(heads[1:], len(on)) - 1]


def _twice(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeats(contexts: list[bytes], left: np.ndarray, row: np.ndarray, place: np.ndarray, gram: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, end): places in the row that repeated strings cover. A context begins ``left`` before ``place`` of its row.

    Strings that are equal have equal grams at equal places, so that strings whose hash is alone there can't repeat; what
    is left of the contexts are stretches, equal ones of which go into the suffix array once.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    inner = np.arange(len(data), dtype=np.int32) - begin.astype(np.int32)[of]
    valid = np.flatnonzero((inner <= left[of]) & (inner + SPAN <= sizes[of]))
    none = np.empty(0, np.int64)
    if not len(valid):
        return none, none, none
    up, down = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=sums[1:])
    at = gram.view(np.uint64)[of[valid]] + (left[of[valid]] - inner[valid]).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    flags = np.zeros(len(data), bool)
    flags[valid[_twice(_mix((sums[valid + SPAN] - sums[valid]) * down[valid] + at))]] = True
    first, last = _runs(flags, of)
    if not len(first):
        return none, none, none
    end, c = last + SPAN, of[first]
    stamp = _mix((sums[end] - sums[first]) * down[first] + gram.view(np.uint64)[c] + (end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one, which, count = np.unique(stamp, return_index=True, return_inverse=True, return_counts=True)
    # the suffix array of one stretch of each kind
    length = (end - first)[one]
    origin = np.cumsum(length) - length
    kind = np.repeat(np.arange(len(one)), length)
    step = np.arange(len(kind)) - origin[kind]
    text = data[first[one][kind] + step]
    keys = octets(np.concatenate([text, np.zeros(SPAN + 16, np.uint8)]))
    order = suffix_array(text, keys)
    order = order[step[order] + SPAN <= length[kind[order]]]
    run = np.cumsum(common_prefixes(order, keys) < SPAN)
    where = place[c[one]] - left[c[one]] + inner[first[one]]
    rows, places = row[c[one]][kind[order]], where[kind[order]] + step[order]
    by = np.lexsort((places, rows, run))
    other = (run[by][1:] == run[by][:-1]) & ((rows[by][1:] != rows[by][:-1]) | (places[by][1:] != places[by][:-1]))
    shared = np.zeros(int(run[-1]) + 1, bool)
    shared[run[by][1:][other]] = True
    hit = np.zeros(len(text), bool)
    hit[order] = shared[run] | (count[kind[order]] > 1)
    head, tail = _runs(hit, kind)
    # and back to every stretch of the kind
    per = np.bincount(kind[head], minlength=len(one))
    offset = np.cumsum(per) - per
    n = per[which]
    s = np.repeat(np.arange(len(first)), n)
    j = offset[which[s]] + np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
    base = place[c[s]] - left[c[s]] + inner[first[s]] - origin[which[s]]
    return c[s], base + head[j], base + tail[j] + SPAN


def _anchor_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, places, grams, around, held = [], [], [], [], 0

            def give():
                columns = (np.concatenate(ids), np.concatenate(places).astype(np.int32), np.concatenate(grams).view(np.int64), np.concatenate(around).view(np.int64))
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "place", "gram", "around"])

            for r, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                p, a, c = anchors(np.frombuffer(t.as_buffer(), np.uint8), powers)
                if len(p):
                    ids.append(np.full(len(p), r, np.int64))
                    places.append(p)
                    grams.append(a)
                    around.append(c)
                    held += len(p)
                if held > 1 << 18:
                    yield give()
                    ids, places, grams, around, held = [], [], [], [], 0
            if held:
                yield give()

    return rows.select("row", "text").mapInArrow(lean(run), "row long, place int, gram long, around long")


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (row, place, gram, key, solo, crowd) with left and context, the bytes that begin ``left`` before the place."""
    fields = ("place", "gram", "key", "solo", "crowd")
    spots = wanted.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct(*fields)).alias("spots"))
    both = rows.join(spots, F.col("row") == F.col("_row")).select("row", "text", "spots")
    names = ["row", *fields, "left", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, t, spots in zip(batch.column(0), batch.column(1), batch.column(2)):
                data, spots = t.as_buffer(), spots.values
                for at in range(0, len(spots), 20_000):
                    some = spots.slice(at, 20_000)
                    place = some.field("place").to_numpy()
                    low = np.maximum(place - BEFORE, 0)
                    context = [data[i:j].to_pybytes() for i, j in zip(low.tolist(), (place + SPAN).tolist())]
                    columns = [pa.array(np.full(len(some), r.as_py())), *(some.field(f) for f in fields), pa.array(place - low, pa.int32()), pa.array(context, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(lean(run), PIECE)


PIECE = "row long, place int, gram long, key long, solo boolean, crowd boolean, left int, context binary"


def _by_suffixes(pieces: DataFrame) -> DataFrame:
    """(row, bytes) of the strings of solo pieces that occur in other pieces of equal gram and key too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, powers = 0, Powers()

        def give():
            row, place, left, gram, key, solo, text = zip(*held)
            row, place, left, gram, key, solo = (np.array(v, k) for v, k in ((row, np.int64), (place, np.int64), (left, np.int64), (gram, np.int64), (key, np.int64), (solo, bool)))
            c, first, end = repeats(list(text), left, row, place, gram ^ key, powers)
            mine = solo[c]
            return pa.RecordBatch.from_arrays([pa.array(row[c[mine]]), pa.array((first[mine] << 32) | end[mine])], ["row", "bytes"])

        for batch in batches:
            for item in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if size >= BLOCK and item[3:5] != held[-1][3:5]:
                    yield give()
                    held, size = [], 0
                held.append(item)
                size += len(item[6])
        if held:
            yield give()

    dealt = pieces.select("row", "place", "left", "gram", "key", "solo", "context").repartition("gram", "key").sortWithinPartitions("gram", "key")
    return dealt.mapInArrow(lean(run), "row long, bytes long")


def _stretch(place: Column, left: Column, size: Column) -> Column:
    low = (place - left).cast("long")
    return F.shiftleft(low, 32).bitwiseOR(low + size).alias("bytes")


def _split(pieces: DataFrame) -> DataFrame:
    """Halves of pieces whose strings begin ``first`` to ``last`` bytes before their place: with kind, a hash of all that a half is.

    A half's new key is a hash of the bytes that all strings of the half hold, of which equal strings have equal ones.
    """
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("first"), middle.alias("last")), F.struct((middle + 1).alias("first"), F.col("last"))))
    rows = pieces.withColumn("half", halves).withColumns({"first": F.col("half.first"), "last": F.col("half.last")}).where("first <= last")
    least = F.col("left") + SPAN - F.length("context")  # the strings of a piece begin so far before its place, or up to left
    rows = rows.withColumns({"_low": F.greatest("first", least), "_high": F.least("last", "left")}).where("_low <= _high")
    core = F.substring("context", F.col("left") - F.col("first") + 1, F.col("first") - F.col("last") + SPAN)
    body = F.substring("context", F.col("left") - F.col("_high") + 1, F.col("_high") - F.col("_low") + SPAN)
    rows = rows.withColumns({"key": F.xxhash64("first", "key", core), "context": body, "left": F.col("_high")})
    return rows.withColumn("kind", F.xxhash64("left", "context")).drop("half", "_low", "_high", "crowd")


def _kinds(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each kind the number and the first piece, and of each key that isn't one piece's the number of kinds. ``pieces``: row, place, gram, key, kind."""
    kinds = settle(pieces.groupBy("gram", "key", "kind").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")))
    keys = kinds.groupBy("gram", "key").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1 OR most > 1")
    return kinds, settle(keys.drop("most"))


def _judged(pieces: DataFrame, kinds: DataFrame, keys: DataFrame) -> DataFrame:
    """``pieces`` of keys of several kinds, or of kinds of several pieces, with n, crowd and chosen, true for one piece of each kind of the former.

    Kinds meet their keys first, so that pieces with no other of their key go before anything is joined to them.
    """
    keys = keys.select(F.col("gram").alias("_g"), F.col("key").alias("_k"), "kinds")
    kinds = kinds.join(keys, (F.col("gram") == F.col("_g")) & (F.col("key") == F.col("_k")))
    kinds = kinds.select(*(F.col(c).alias(f"_{c}") for c in ("gram", "key", "kind")), "n", "one", "kinds")
    out = pieces.join(kinds, (F.col("gram") == F.col("_gram")) & (F.col("key") == F.col("_key")) & (F.col("kind") == F.col("_kind")))
    chosen = (F.struct("row", "place") == F.col("one")) & (F.col("kinds") > 1)
    return out.withColumns({"chosen": chosen, "crowd": F.col("kinds") > CROWD}).drop("_gram", "_key", "_kind", "one", "kinds")


def repeated(rows: DataFrame) -> DataFrame:
    """(row, bytes) for each covered stretch: first << 32 | end, which may go beyond the text's end. ``rows``: row, text, both unique."""
    spark, every = rows.sparkSession, settle(_anchor_rows(rows))
    many = settle(every.groupBy(F.col("gram").alias("_gram")).agg(F.count("*").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi")).where("n > 1"))
    discard(spark)
    found = settle(every.join(many, F.col("gram") == F.col("_gram")).select("row", "place", "gram", "around", (F.col("lo") != F.col("hi")).alias("several")))
    discard(spark, every, many)
    several = found.where("several").select("row", "place", "gram", F.lit(0).cast("long").alias("key"), F.col("around").alias("kind"))
    kinds, keys = _kinds(several)
    judged = settle(_judged(several, kinds, keys))
    discard(spark, kinds, keys)
    left = F.least(F.col("place"), F.lit(BEFORE))
    around = _stretch(F.col("place"), left, left + SPAN)
    out = [found.where(~F.col("several")).select("row", around), judged.where("n > 1").select("row", around)]
    wanted = judged.where("chosen").select("row", "place", "gram", "key", (F.col("n") == 1).alias("solo"), "crowd")
    pieces = settle(_contexts(rows, wanted))
    spent = [found, judged, pieces]
    out.append(_by_suffixes(pieces.where(~F.col("crowd"))))
    crowds = pieces.where("crowd").withColumns({"first": F.lit(0), "last": F.lit(BEFORE)})
    while not crowds.isEmpty():  # halves of halves: each string by itself after eight turns
        halves = settle(_split(crowds))
        kinds, keys = _kinds(halves)
        judged = settle(_judged(halves, kinds, keys))
        discard(spark, halves, kinds, keys)
        spent.append(judged)
        out.append(judged.where("n > 1 AND solo").select("row", _stretch(F.col("place"), F.col("left"), F.length("context"))))
        chosen = judged.where("chosen").withColumn("solo", F.col("solo") & (F.col("n") == 1)).drop("n", "chosen", "kind")
        out.append(_by_suffixes(chosen.where(~F.col("crowd"))))
        crowds = chosen.where("crowd")
    out = settle(reduce(DataFrame.union, out))
    discard(spark, *spent)
    return out


def _cut(text: pd.Series, stretches: pd.Series) -> pd.DataFrame:
    kept, spans, sizes = [], [], []
    for t, s in zip(text, stretches):
        data = t.encode("utf-8")
        sizes.append(len(data))
        if s is None or not len(s):
            kept.append(data)
            spans.append([])
            continue
        s = np.sort(np.asarray(s, np.int64))
        first, end = s >> 32, np.minimum(np.maximum.accumulate(s & 0xFFFFFFFF), len(data))
        new = np.ones(len(s), bool)
        new[1:] = first[1:] > end[:-1]
        heads = np.flatnonzero(new)
        a, b = first[heads].tolist(), end[np.append(heads[1:], len(s)) - 1].tolist()
        kept.append(b"".join(data[i:j] for i, j in zip([0, *b], [*a, len(data)])))
        spans.append([x for pair in zip(a, b) for x in pair])
    return pd.DataFrame({"n_bytes": sizes, "kept": kept, "removed": spans})


def cut(docs: DataFrame) -> DataFrame:
    """``docs`` with n_bytes, kept (the bytes that stay) and removed (first, end, first, end, ... of the maximal removed runs)."""
    names = ("n_bytes", "kept", "removed")
    spark, (own, back) = docs.sparkSession, aside(docs, "text")
    rows = own.withColumn("_whole", whole()).withColumns({"_a": F.xxhash64("_whole"), "_b": F.xxhash64(F.lit("b"), "_whole")})
    texts = rows.groupBy("_a", "_b").agg(F.first("_whole").alias("text"), F.count("*").alias("copies"))
    texts = settle(texts.select(F.monotonically_increasing_id().alias("row"), "_a", "_b", "text", "copies"))
    discard(spark)
    found = repeated(texts.select("row", "text"))
    size = F.octet_length("text").cast("long")
    stretches = found.union(texts.where((F.col("copies") > 1) & (size >= SPAN)).select("row", size.alias("bytes")))
    by_text = stretches.groupBy(F.col("row").alias("_row")).agg(F.collect_list("bytes").alias("_bytes"))
    by_text = by_text.join(texts.select("row", F.col("_a").alias("_ta"), F.col("_b").alias("_tb")), F.col("row") == F.col("_row"))
    by_text = settle(by_text.select("_ta", "_tb", "_bytes"))
    discard(spark, found, texts)
    made = F.pandas_udf(_cut, "n_bytes long, kept binary, removed array<long>")
    out = rows.join(by_text, (F.col("_a") == F.col("_ta")) & (F.col("_b") == F.col("_tb")), "left").withColumn("_made", made("_whole", "_bytes"))
    return out.select(*back(*names), *(F.col(f"_made.{k}").alias(k) for k in names))


def text() -> Column:
    """What cut() keeps, as text."""
    return F.pandas_udf(lambda s: s.map(lambda b: b.decode("utf-8", "ignore")), "string")("kept")


def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(documents(spark, folder).select("doc_id", "text"))
    gone = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substrings": op2_substrings}
ORACLES: dict = {}
