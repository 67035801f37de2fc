"""Cross-tokenizer alignment, whitening and exact top-k against plain versions."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_cases import DOCS, rows
from tokenizers import Tokenizer

from quarry.llm import alignment, maxscore, whitening

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return spec, f.read()


def plain_alignment(texts, spec, model):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)], byte by byte."""
    a, b = Tokenizer.from_str(spec), sentencepiece.SentencePieceProcessor(model_proto=model)
    a.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(alignment.byte_letters())}
    found, pairs = [], Counter()
    for t in texts:
        x = a.encode(" " + (t or ""), add_special_tokens=False).ids
        y = b.encode(t or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + t.encode():
            found.append(None)
            continue
        end_a = dict(zip(itertools.accumulate(map(len, bytes_a)), x))
        end_b = dict(zip(itertools.accumulate(map(len, bytes_b)), y))
        links = [(end_a[p], end_b[p]) for p in sorted(end_a) if p in end_b]
        pairs.update(links)
        groups, now = [], ([], [])
        for p in sorted({*end_a, *end_b}):
            for side, ends in zip(now, (end_a, end_b)):
                if p in ends:
                    side.append(str(ends[p]))
            if p in end_a and p in end_b:
                groups.append("|".join(map(",".join, now)))
                now = ([], [])
        found.append((len(x), len(y), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            x, y, links, groups = f
            out.append((x, y, len(links), len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), groups))
    return out


ODD_TEXTS = [r[1] for r in rows()] + ["a <|endoftext|> b </s> <s> <unk> <0x41>", "▁", "a ▁b", "  two  spaces ", " lead", "tab\tand\nline\r\n", "日本語。テキスト、です", "👩‍👩‍👧 ok", "\x00nul", "é", "́́", "\U0001e900\U0001e901 x", "x" * 3000, " " * 50]


@pytest.mark.parametrize("slice_bytes,block_bytes", [(alignment.SLICE_BYTES, alignment.BLOCK_BYTES), (300, 1000)])
def test_alignment(spark, files, monkeypatch, slice_bytes, block_bytes):
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    given = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = ODD_TEXTS + given + given[:3]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, block int, pairs int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df, *files).collect()}
    want = plain_alignment(texts, *files)
    assert sum(w[0] == 0 for w in want) >= 5 and sum(w[0] > 0 for w in want) > 200
    assert [got[i] for i in range(len(texts))] == want


def test_alignment_query(spark, files, tmp_path):
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_alignment([r[1] for r in rows()], *files)
    want = sorted(str((r[0], *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "")) for r, w in zip(rows(), want))
    assert sorted(str(tuple(r)) for r in alignment.op11_align(spark, str(tmp_path)).collect()) == want
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert alignment.op11_align(spark, f"{tmp_path}/none").collect() == []


def test_a_common_pair_asks_once_a_block(spark, files, monkeypatch):
    """Documents of a pair that all of them hold make a row a block, not a row a document."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 10_000)
    df = spark.range(4000).selectExpr("id AS doc_id", "'the word' AS text").repartition(4)
    made = alignment.pair_rows(alignment.grouped(df, *files)).collect()
    assert len({r.block for r in made}) >= 4 and len(made) == 2 * len({r.block for r in made})
    assert sum(r.n for r in made) == 8000


VECTORS = "vec_id long, embedding array<float>, n int, x int, deviation string, `a.b` int"


def vectors(spark, given):
    return spark.createDataFrame([(i, v, 1, 2, "d", 3) for i, v in given], VECTORS).repartition(3)


def plain_whitening(given, components=8):
    fit = [(i, v) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in fit), default=0)
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (dims - len(v)) for _, v in fit]
    n, total = len(fit), [sum(c) for c in zip(*x)]
    y = np.array([[(n * a - s) / n for a, s in zip(r, total)] for r in x])
    values, parts = np.linalg.eigh(y.T @ y / n)
    values, parts = values[::-1], parts[:, ::-1]
    z = y @ parts / np.sqrt(np.where(values > 1e-9 * max(values[0], 1e-300), values, np.nan))
    return [(i, n, sum((n * a - s) ** 2 for a, s in zip(r, total)), z[k, :components], values[:components] / values.sum()) for k, ((i, _), r) in enumerate(zip(fit, x))]


def test_whitening(spark):
    given = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    nan, inf = float("nan"), float("inf")
    odd = [(None, given[0][1]), (3, given[1][1]), (3, given[1][1]), (900, None), (901, [nan] + [0.0] * 63), (902, [None] * 64), (903, [inf] + [0.0] * 63), (904, [0.5] * 60), (905, [])]
    given += odd
    want = sorted(plain_whitening(given), key=lambda w: (str(w[0]), w[2]))
    out = whitening.whiten(vectors(spark, given))
    assert {"vec_id", "embedding", "x", "a.b", "n", "deviation", "whitened"} <= set(out.columns) and len(out.columns) == len(set(out.columns)) == 9
    got = sorted(out.collect(), key=lambda r: (str(r.vec_id), int(r.deviation)))
    assert [(r.vec_id, r.n, int(r.deviation)) for r in got] == [w[:3] for w in want] and {r["a.b"] for r in got} == {3}
    signs = np.sign([w[3][0:8] @ np.ones(8) for w in want][0:1])  # noqa: F841
    a, b = np.array([r.whitened for r in got]), np.array([w[3] for w in want])
    b = b * np.sign((a * b).sum(axis=0))
    assert np.abs(a - b).max() < 1e-6
    assert np.allclose([r.explained for r in got], [w[4] for w in want], rtol=1e-6) and {r.identity_error for r in got} < {x for x in [got[0].identity_error]} | {0.0}
    assert got[0].identity_error < 1e-9
    cov = (a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) / len(a)
    assert np.abs(cov - np.eye(8)).max() == pytest.approx(got[0].identity_error, abs=1e-9)


def test_whitening_query(spark):
    got = whitening.op12_whiten(spark, SF)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    by = {(r.vec_id, r.component): r for r in got.collect()}
    given = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert len(by) == 8 * len(given)
    for i, n, far, _, explained in plain_whitening(given):
        assert all(by[i, k + 1].n == n and by[i, k + 1].deviation == far and by[i, k + 1].explained == pytest.approx(explained[k]) for k in range(8))


@pytest.mark.parametrize("given", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(5)], [(i, [i / 8, -i / 4, 0.0]) for i in range(5)], [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])]])
def test_whitening_of_few(spark, given):
    got = sorted(whitening.whiten(vectors(spark, given)).collect(), key=lambda r: r.vec_id)
    want = 0 if not given or not given[0][1] else len(given)
    assert len(got) == want
    for r in got:
        assert r.n == want and len(r.whitened) == len(given[0][1])
        known = [w for w in r.whitened if w is not None]
        assert len(known) == (0 if len({str(v) for _, v in given}) == 1 else 1 if len(given[0][1]) == 3 else len(known))
        assert (r.identity_error is None) == (not known) and (not known or r.identity_error < 1e-6)
    if len(given) == 3:
        assert sum(int(r.deviation) for r in got) > 1 << 64  # beyond a long, exact all the same
        top = (1 << 52) + 0
        x = [[top, 101_024], [-top, 102_048], [100_000, 104_096]]
        assert [int(r.deviation) for r in got] == [sum((3 * a - s) ** 2 for a, s in zip(v, map(sum, zip(*x)))) for v in x]


def plain_topk(given, k=5, of=50):
    some = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    clip = lambda s: max(-(1 << 63), min(s, (1 << 63) - 1))
    out = []
    for a, (i, q) in enumerate(some):
        if i is not None and i % of == 0:
            best = sorted((-clip(sum(p * r for p, r in zip(map(clip, q), map(clip, v)))), j is None, j or 0) for b, (j, v) in enumerate(some) if a != b)[:k]
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(best, 1)]
    return sorted(map(str, out))


def topk(df):
    rows = maxscore.integers(df)
    return sorted(str(tuple(r)) for r in maxscore.search(rows, rows.where(F.col("vec_id") % 50 == 0)).collect())


def test_topk(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = maxscore.op13_topk(spark, SF)
    cols = sorted(got.columns)
    assert sorted(str(tuple(r)) for r in got.select(cols).collect()) == sorted(map(str, con.sql(maxscore.ORACLES["op13_topk"]).select(*cols).fetchall()))
    given = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_topk(given)


@pytest.mark.parametrize("shard,block", [(1 << 22, 1 << 19), (250, 36)])
def test_topk_on_awkward_rows(spark, monkeypatch, shard, block):
    monkeypatch.setattr(maxscore, "SHARD_ENTRIES", shard)
    monkeypatch.setattr(maxscore, "BLOCK_ENTRIES", block)
    rng, nan = random.Random(5), float("nan")
    one = [rng.gauss(0, 0.2) for _ in range(12)]
    given = [(i, one) for i in range(0, 120, 3)] + [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(400)]  # a hot vector, repeated ids
    given += [(50, one), (50, one), (None, one), (None, [0.0] * 12), (100, [0.0] * 12), (150, [1.0]), (200, []), (250, None), (300, [nan] * 12), (350, [None] * 12), (-50, [-0.1] * 12), (400, [-1.0, 0.0])]
    assert topk(vectors(spark, given)) == plain_topk(given)
    huge = [(i, [3e38 * rng.choice((1, -1, 0)), 1e15, float(i)]) for i in range(0, 200, 10)]
    assert topk(vectors(spark, huge)) == plain_topk(huge)
    wide = [(i, [rng.uniform(-1, 1) * 1e7 for _ in range(4)]) for i in range(0, 200, 10)]  # beyond exact doubles
    assert topk(vectors(spark, wide)) == plain_topk(wide)
    for few in ([], [(0, one)], [(0, one), (1, one)], [(1, one), (2, one)]):
        assert topk(vectors(spark, few)) == plain_topk(few)


def test_topk_prunes(monkeypatch):
    """Some terms of most queries are non-essential, and few vectors are probed in them."""
    rng = np.random.default_rng(2)
    x = np.where(rng.random((4000, 64)) < 0.1, rng.integers(-200, 200, (4000, 64)), rng.integers(-3, 4, (4000, 64))).astype(float)
    shard = maxscore.Shard(np.arange(4000), list(range(4000)), x, 5)
    probed, plain = [], maxscore.Shard.best

    def spied(self, q, own, others, upto, least, score):
        probed.append((len(others), int((score + (upto[len(others) - 1] if len(others) else 0) >= least).sum())))
        return plain(self, q, own, others, upto, least, score)

    monkeypatch.setattr(maxscore.Shard, "best", spied)
    asked = np.arange(0, 2000, 10)
    for i, got in zip(asked, shard.search(x[asked], asked)):
        assert [(-s, j) for j, s in got] == sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
    terms, vectors = zip(*probed)
    assert np.mean(terms) > 20 and np.mean(vectors) < 400
