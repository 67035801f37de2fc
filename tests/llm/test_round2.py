"""Cases that the verdict on round 1 found missing: values on awkward tables, clashing names, plain versions of the models."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_against_brute_force import library, removed, sha
from test_cases import DOCS, rows
from tokenizers import Tokenizer

from quarry.llm import bpe, language, mixing, quality, substrings, tokenfile

ODD = rows() + [(50, "a <|endoftext|> b", "en", "a", 1, 5, "a", "b", "c", "d", 6, 7)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, DOCS).repartition(3).write.parquet(f"{top}/documents.parquet")
    return top


def test_token_file_on_awkward_rows(spark, folder):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {(r[0], r[1] or ""): own.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in ODD}
    want = sorted(((r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r in ODD for i in [ids[r[0], r[1] or ""]]), key=str)
    got = sorted(tokenfile.op10_tokenfile(spark, folder).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    keys = [(r.doc_id is None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys) and [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]


def test_files_in_order_of_ids(spark, tmp_path):
    df = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("doc_id"), F.lit("some words " * 900).alias("text"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenfile.write(df, str(tmp_path / "f"), f.read())
    found = []
    for part in sorted((tmp_path / "f").glob("*.parquet")):
        found += [d for r in spark.read.parquet(str(part)).orderBy("shard", "segment").collect() for d in tokenfile.Segment(bytes(r.payload)).doc_ids]
    assert found == list(range(3000)) and len(list((tmp_path / "f").glob("*.parquet"))) > 1


def test_bpe_on_awkward_rows(spark, folder):
    own = library()
    want = sorted(((r[0], sha(",".join(map(str, own.encode_ordinary(r[1] or "")))), sha(r[1] or "")) for r in ODD), key=str)
    assert sorted(((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.op3_bpe(spark, folder).collect()), key=str) == want


def test_substrings_on_awkward_rows(spark, folder):
    texts = [(r[1] or "").encode() for r in ODD]
    want = sorted(((r[0], len(t), len(c) // 2, hashlib.sha256(b"".join(t[i:j] for i, j in zip([0, *c[1::2]], [*c[::2], len(t)]))).hexdigest()) for r, t, c in zip(ODD, texts, removed(texts))), key=str)
    got = sorted(((r.doc_id, r.n_bytes, r.n_spans, r.kept_sha256) for r in substrings.op2_substrings(spark, folder).collect()), key=str)
    assert got == want


NAMES = "pattern position rank weight cap ratio total full open level target size copies taken positions source_size _queue _range _in _s _r _of _given _words _whole _a _b _row _bytes _made _found key lang_pred score kept removed n_bytes `a.b`".split()


def test_any_column_names(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * 60, "en" if i % 2 else "fr", "s") for i in range(6)], "doc_id long, text string, lang string, source string")
    wide = docs.select("*", *(F.lit(i).alias(n.strip("`")) for i, n in enumerate(NAMES)))
    for out, made in (
        (mixing.mix(wide), {"position"}),
        (substrings.cut(wide), {"kept", "removed", "n_bytes"}),
        (language.identify(wide, language.fit(wide)), {"lang_pred", "score"}),
    ):
        assert sorted(out.columns) == sorted(wide.columns)
        for r in out.collect():
            assert all(r[n.strip("`")] == i for i, n in enumerate(NAMES) if n not in made)


def test_rules_as_column_and_as_plain_rules(spark):
    """The compiled column against the rules one by one, and the statistics of texts against plain counts."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stats = quality.statistics(docs, "doc_id")
    model = quality.fit(stats, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.rules
    for r in stats.withColumn("score", model.column()).collect():
        z = model.intercept
        for rule, weight in model.rules:
            if all((r[quality.STATISTICS[f]] > cut) == above for f, above, cut in rule):
                z += weight
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in stats.collect():
        words = __import__("re").findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        chars = sum(map(len, words))
        assert r.words == pytest.approx(np.log1p(len(words))) and r.distinct_share == pytest.approx(len(set(words)) / len(words) if words else 0)
        assert r.bang_share == pytest.approx(texts[r.doc_id].count("!") / chars if chars else 0)
        assert r.double_share == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / len(words) if words else 0)


def test_votes_within_the_family(spark):
    """predict() against families and votes counted one by one."""
    rng = np.random.default_rng(4)
    langs = ["en", "de", "nl", "fr", "es", "xx"]
    base = np.abs(rng.normal(size=(len(langs), language.BUCKETS))).astype(np.float32)
    y = [langs[i % 6] for i in range(180)]
    x = np.stack([base[langs.index(c)] + np.abs(rng.normal(size=language.BUCKETS)) for c in y]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language.Model(language._with_one(x), y)
    got, score = model.predict(x)
    assert np.mean([a == b for a, b in zip(got, y)]) > 0.9 and (0 <= score).all() and (score <= 1).all()
    for v, lang in zip(language._with_one(x), got):
        z = [float(v @ w) for w in model.family.T]
        family = model.families[int(np.argmax(z))]
        votes = dict.fromkeys(model.members[family], 0.0)
        for a, b, w, slope, shift in model.pairs[family]:
            q = 1 / (1 + np.exp(-np.clip(slope * float(v @ w) + shift, -30, 30)))
            votes[a] += (q > 0.5) + q / (len(votes) + 1)
            votes[b] += (1 - q > 0.5) + (1 - q) / (len(votes) + 1)
        assert lang == max(sorted(votes), key=lambda c: votes[c])


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "EACH", 20)
    docs = spark.range(4000).selectExpr("id % 1500 AS doc_id", "'repeated' AS text", "IF(id % 10 = 0, 'fr', 'en') AS lang")
    got = language.sample(docs).groupBy("_lang").count().collect()
    assert {(r._lang, r["count"]) for r in got} == {("en", 20), ("fr", 20)}
    assert language.fit(docs.where("lang IS NULL")) is None
    one = language.identify(docs.limit(5), language.fit(docs.withColumn("lang", F.lit("en"))))
    assert {(r.lang_pred, r.score) for r in one.collect()} == {("en", 1.0)}


def test_language_stage_without_languages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "plain words", None, "a", 11), (2, "#### 12", None, "a", 7), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]
