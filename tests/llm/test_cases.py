"""Every operator on awkward tables, and on empty ones."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm import chat, language, mixing, neardup, quality, substrings, winnow
from quarry.llm.common import n_words, whole
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, kept string, score string, position string, node int, marks int"
PROSE = "the quick brown fox jumps over the lazy dog while seventeen patient turtles cross a narrow bridge at dawn "


def varied(n, seed):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 99991:x}" for i in range(n))


def rows():
    texts = [None, "", "  \n\t ", "#### ||| $$$", "x", varied(300, 1), varied(300, 1), varied(300, 1) + " end", "aaaa" * 5000, PROSE * 40]
    texts += [varied(60_000, 2), "é" * 500, "\U0001f600 emoji   and \x1c control   space", varied(80, 3), varied(80, 4)]
    out = [(i, t, ("en", "fr", "de", None)[i % 4], ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, varied(90, 5), "en", "a", 1), (None, None, None, None, None), (-7, varied(90, 6), "en", "B", 2)]
    return [(*r, 5, "a", "b", "c", "d", 6, 7) for r in out]


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    top, some = str(tmp_path_factory.mktemp(request.param)), request.param == "odd"
    spark.createDataFrame(rows() if some else [], DOCS).repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(10)] + [(3, None, None), (3, 1, 0), (None, 1, 0)]
    spark.createDataFrame(labels if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", None), (2, 2, "user", "<|im_end|>")]
    turns += [(3, 0, None, "a"), (3, 0, None, "a"), (None, None, None, None), (4, 0, "user", "hi"), (5, 0, "user", "other"), (6, 0, "user", "other")]
    spark.createDataFrame(turns if some else [], "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return top


@pytest.mark.parametrize("name", [k for k in entry.queries() if k.startswith("op") and k not in ("op5_chat", "op12_whiten", "op13_topk")] + ["pipeline"])  # those of the documents
def test_all_rows(spark, folder, name):
    got = entry.queries()[name](spark, folder).collect()
    want = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert len(got) == want or name == "pipeline" and bool(got) == bool(want)


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_columns(spark, folder, at):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.STAGES[at][1](spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    out.collect()


def test_chat(spark, folder):
    got = {r.conv_id: r for r in chat.op5_chat(spark, folder).collect()}
    if not got:
        return
    assert set(got) == {2, 3, None, 5} and got[5].n_logged == 2 and got[3].n_turns == 2
    assert got[2].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\n< |im_end|><|im_end|>\n"


def test_long_conversation_in_parts(spark):
    turns = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    cut = turns.where("turn < 2000").withColumn("conv_id", F.lit(0).cast("long"))
    got = sorted(chat.render(turns.union(cut)).collect(), key=lambda r: (r.conv_id, r.part))
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 1024), (1, 1024), (1, 952)]
    assert "".join(r.rendered for r in got).count("im_start") == 3000


def test_defined_values(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    if docs.isEmpty():
        return
    by = lambda df: {r.doc_id: r for r in df.collect()}
    a = by(winnow.op4_winnow(spark, folder))
    assert a[1].fingerprint == "" and a[1].near_next == 1.0 and a[5].fingerprint == a[6].fingerprint
    b = by(language.op9_language(spark, folder))
    assert b[1].lang_pred == b[3].lang_pred == "und" and b[3].score == 0 and 0 <= b[5].score <= 1
    c = by(neardup.op6_neardup(spark, folder))
    assert c[5].class_id == c[6].class_id == c[7].class_id == 5 and c[1].class_id == 1 and c[2].class_id == 2
    d = by(substrings.op2_substrings(spark, folder))
    assert d[5].n_removed == d[5].n_bytes and d[8].n_removed == 20000 and d[8].n_spans == 1 and d[4].n_removed == 0
    e = by(mixing.op1_mix(spark, folder))
    assert all(0 <= r.taken <= 2 * r.size for r in e.values()) and e[0].size == 0
    f = by(quality.op8_quality(spark, folder))
    assert all(0 <= r.score <= 1 for r in f.values())
    kept = neardup.drop_duplicates(docs).collect()
    assert sum(r.doc_id == 5 for r in kept) == 1 and not any(r.doc_id in (6, 7) for r in kept) and {1, 2, 0} <= {r.doc_id for r in kept}
    mixed = mixing.mix(docs, n_words(whole())).collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
