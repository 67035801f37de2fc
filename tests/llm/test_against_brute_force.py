"""Operators beyond SQL against plain versions of what they compute."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import bpe, chat, language, mixing, neardup, quality, rules, substrings, tokenfile, winnow

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("part,name", [(mixing, "op1_mix"), (chat, "op5_chat"), (rules, "op7_rules")])
def test_sql(spark, part, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = part.QUERIES[name](spark, SF), con.sql(part.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(str(tuple(r)) for r in got.select(cols).collect()) == sorted(map(str, want.select(*cols).fetchall()))


def test_mix_meets_targets(spark):
    rows = mixing.op1_mix(spark, SF).collect()
    total, spent = sum(r.size for r in rows), Counter()
    targets = {r.source_size: r.target for r in rows}
    for r in rows:
        spent[r.source_size] += r.taken
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    largest = max(r.size for r in rows)
    assert all(abs(spent[s] - t) <= largest and t <= 2 * s + 1e-6 for s, t in targets.items())
    assert rows == mixing.op1_mix(spark, SF).collect()


def test_substrings(spark, docs):
    seen = Counter()
    for r in docs.values():
        b = r.text.encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for got in substrings.op2_substrings(spark, SF).collect():
        b = docs[got.doc_id].text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        assert (got.n_bytes, got.n_removed, got.n_spans) == (len(b), sum(gone), spans)
        assert got.kept_sha256 == sha(bytes(x for x, g in zip(b, gone) if not g))


def test_crowded_anchors_are_split(spark, docs, monkeypatch):
    want = sorted(map(str, substrings.op2_substrings(spark, SF).collect()))
    monkeypatch.setattr(substrings, "CROWD", 1)
    assert sorted(map(str, substrings.op2_substrings(spark, SF).collect())) == want


def removed(texts):
    """Of each text the runs that strings of 200 bytes which occur twice cover."""
    seen, out = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199)), []
    for b in texts:
        runs = []
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                if runs and runs[-1] >= i:
                    runs[-1] = i + 200
                else:
                    runs += [i, i + 200]
        out.append(runs)
    return out


@pytest.mark.parametrize("crowd", [2000, 7])
def test_passage_in_many_texts(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rng = random.Random(7)
    say = lambda n: "".join(chr(rng.choice((97, 98, 99, 233))) for _ in range(n))
    passage, tail = say(700), say(150)
    texts = [say(rng.randrange(60)) + passage + tail[: rng.randrange(150)] + say(rng.randrange(90)) for _ in range(60)]
    texts += [say(400), passage[100:320], passage[:90], "ab" * 500, texts[0], texts[1][:500], say(10) + texts[2][50:600] + say(30)] + [texts[3]] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: list(r.removed) for r in substrings.cut(df).collect()}
    assert [got[i] for i in range(len(texts))] == removed([t.encode() for t in texts])


def test_equal_rows_cost_as_one(spark, monkeypatch):
    """A thousand equal rows make as many anchors as one."""
    made, plain = [], substrings._anchor_rows

    def counted(rows):
        out = plain(rows)
        made.append(out.count())
        return out

    monkeypatch.setattr(substrings, "_anchor_rows", counted)
    t = " ".join(f"w{i}" for i in range(900))
    for n in (1, 1000):
        df = spark.range(n).selectExpr("id % 3 AS doc_id", f"'{t}' AS text")
        assert {len(r.removed) for r in substrings.cut(df).collect()} == {0 if n == 1 else 2}
    assert made[0] == made[1] > 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.integers(0, 2**32), st.integers(1, 500))
def test_suffix_array(letters, seed, n):
    rng = random.Random(seed)
    s = bytes(97 + rng.randrange(letters) for _ in range(n))
    data = np.frombuffer(s, np.uint8)
    keys = substrings.octets(np.concatenate([data, np.zeros(substrings.SPAN + 16, np.uint8)]))
    order = substrings.suffix_array(data, keys)
    cut = [s[i : i + substrings.SPAN] for i in order]
    assert sorted(order) == list(range(n)) and cut == sorted(cut)
    for a, b, k in zip(cut, cut[1:], substrings.common_prefixes(order, keys)[1:]):
        assert a[:k] == b[:k] and (k == substrings.SPAN or (a + b"\0")[k : k + 1] != (b + b"\0")[k : k + 1] or k >= min(len(a), len(b)))


def test_anchor_tiles(monkeypatch):
    data = np.frombuffer(bytes(random.Random(3).randrange(97, 123) for _ in range(40_000)), np.uint8)
    whole = substrings.anchors(data, substrings.Powers())
    monkeypatch.setattr(substrings, "TILE", 3000)
    for a, b in zip(whole, substrings.anchors(data, substrings.Powers())):
        assert (a == b).all()


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs):
    own = library()
    for got in bpe.op3_bpe(spark, SF).collect():
        ids = own.encode_ordinary(docs[got.doc_id].text)
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(docs[got.doc_id].text))


def test_bpe_odd_texts(spark):
    texts = ["", None, "a\x1c b c", "naïve Straße Привет 世界 \U0001f600", "<|endoftext|>", "x" * 3000, "  \n\n  a", "กำ"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    own = library()
    for r in bpe.encode(df, bpe.ranks_file()).collect():
        t = texts[r.doc_id] or ""
        assert list(r.ids) == own.encode_ordinary(t) and bytes(r.decoded).decode() == t


def test_fingerprints(spark, docs):
    def turned(x, n):
        n %= 64
        return (x << n | x >> (64 - n)) & (2**64 - 1)

    def marks(text):
        runs = __import__("re").findall(r"[^\x20\x09-\x0D]+", text)
        words = [w for r in runs for w in ([r] if len(r) <= 16 else r)]
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        h += [0] * max(0, 5 - len(h)) if h else []
        g, rolled = [], 0
        for i, x in enumerate(h):  # the hash rolls: the word that leaves is taken out, the rest turned, the next put in
            rolled = turned(rolled ^ (turned(h[i - 5], 4) if i >= 5 else 0), 1) ^ x
            if i >= 4:
                g.append(rolled >> 28)
        kept = []
        for i in range(max(1, len(g) - 7) if g else 0):
            place = min(range(i, min(i + 8, len(g))), key=lambda j: (g[j], -j))
            if not kept or kept[-1] != place:
                kept.append(place)
        return g, kept

    ids = sorted(docs)
    for got in winnow.op4_winnow(spark, SF).collect():
        t, after = docs[got.doc_id].text, docs[ids[(ids.index(got.doc_id) + 1) % len(ids)]].text
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got.n_chars, got.edited_sha256) == (len(t), sha(edited))
        for text, printed in ((t, got.fingerprint), (edited, got.edited_fingerprint)):
            g, kept = marks(text)
            assert printed == " ".join(f"{g[p]:x}@{p}" for p in kept)
        a, b, c = ({x.split("@")[0] for x in f.split()} for f in (got.fingerprint, got.edited_fingerprint, winnow_text(marks(after))))
        assert got.near_edited == pytest.approx(len(a & b) / len(a | b)) and got.near_next == pytest.approx(len(a & c) / len(a | c))


def winnow_text(found):
    return " ".join(f"{found[0][p]:x}@{p}" for p in found[1])


def subsequence(a, b):
    """Length of the longest common subsequence, without a band."""
    masks = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for x in b:
        up = row & masks.get(x, 0)
        row = ((row + up) | (row - up)) & whole
    return len(a) - row.bit_count()


def near_pairs(docs):
    """Pairs of ids with their similarity by aligned words, and by shingles."""
    words = {i: neardup.words_of(r.text) for i, r in docs.items()}
    bags = {i: Counter(w) for i, w in words.items()}
    shingles = {i: Counter(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else Counter([tuple(w)]) for i, w in words.items()}
    for a in docs:
        for b in docs:
            n = len(words[a]) + len(words[b])
            if a < b and (bags[a] & bags[b]).total() >= 0.8 / 1.8 * n - 1e-6:
                k = subsequence(words[a], words[b])
                m = (shingles[a] & shingles[b]).total()
                yield a, b, k / (n - k), m / (shingles[a].total() + shingles[b].total() - m)


def test_near_duplicates(spark, docs):
    of = {r.doc_id: r.class_id for r in neardup.op6_neardup(spark, SF).collect()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, s, by_shingles in near_pairs(docs):
        if s >= 0.8:
            assert of[a] == of[b]
            a, b = sorted((find(a), find(b)))
            root[b] = a
        else:
            assert by_shingles < 0.8
    assert of == {i: find(i) for i in docs}


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    # texts that share a long passage but aren't near each other
    rows += [(1000 + i, " ".join(base[:120] + [f"u{rng.randrange(10**6)}" for _ in range(120)])) for i in range(200)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[i] == i for i in range(1000, 1200))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.integers(0, 45))
def test_banded_alignment(a, b, band):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best = max(table[i][j + 1], table[i + 1][j])
            table[i + 1][j + 1] = max(best, table[i][j] + 1) if x == y and abs(i - j) <= band else best
    got = neardup.common(np.array(a, np.uint64), np.array(b, np.uint64), band)
    assert got >= table[-1][-1] and (band < 40 or got == table[-1][-1])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=200, max_size=400), st.integers(0, 2**32), st.integers(0, 30))
def test_banded_alignment_of_frequent_words(a, seed, edits):
    rng, b = random.Random(seed), list(a)
    for _ in range(edits):
        at = rng.randrange(len(b))
        b[at : at + rng.randrange(2)] = [rng.randrange(5)] * rng.randrange(2)
    want = subsequence(a, b)
    assert neardup.common(np.array(a, np.uint64), np.array(b, np.uint64), edits) == want
    s = neardup.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
    assert s == (want / (len(a) + len(b) - want) if want >= 0.8 / 1.8 * (len(a) + len(b)) else 0) or s < 0.8


def test_token_file(spark, docs):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = {r.doc_id: r for r in tokenfile.op10_tokenfile(spark, SF).collect()}, 0
    for i in sorted(docs):
        ids = own.encode(docs[i].text, add_special_tokens=False).ids + [0]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1200))
def test_segments(ids):
    payload = tokenfile.pack(np.array(ids, np.uint32), [None, 5], [len(ids), 0])
    s = tokenfile.Segment(payload)
    assert s.ids().tolist() == ids and s.doc_ids == [None, 5] and s.lengths.tolist() == [len(ids), 0]
    for k in range(len(s.low)):
        assert s.blocks(np.array([k]))[0][: len(ids) - k * 256].tolist() == ids[k * 256 : (k + 1) * 256]
    with pytest.raises(ValueError):
        tokenfile.Segment(b"\0" * 64)


def test_language(spark, docs):
    rows = [r for r in language.op9_language(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows]) >= 0.95


def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op8_quality(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) >= 0.9


def test_binomial_bound(spark):
    from math import comb

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 50), (3, 700), (20, 2000)], "k long, n long")
    for r in df.select("k", "n", rules.at_most(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "mixture":
            order = [(r.doc_id, r.text) for r in mixing.mix(docs).orderBy("position", "doc_id").collect()]
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        seen[name] = docs.collect()
    own, want = library(), []
    assert [(r.doc_id, r.text) for r in seen["mixture"]] == order
    for at, r in enumerate(seen["mixture"]):
        ids = own.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text), at))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position").collect()
    assert list(map(tuple, got)) == want
    classes = {r.doc_id: r.class_id for r in neardup.op6_neardup(spark, SF).collect()}
    assert {r.doc_id for r in seen["near_duplicates"]} == set(classes.values()) and len(seen["language"]) == 200
    assert len(seen["repeated_strings"]) == len(seen["near_duplicates"])
