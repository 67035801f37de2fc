"""Cases that the review of round 1 found missing."""

import random

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import chat, neardup, tokenfile, winnow


def test_twins_in_a_family_of_versions(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]

    def edited(words, k):
        w = list(words)
        for i in rng.sample(range(len(w)), k):
            w[i] = f"v{rng.randrange(10**9)}"
        return w

    rows = []
    for i in range(60):  # versions below 0.8 to each other, each with a twin of 0.93 or so
        v = edited(base, 32)
        rows += [(2 * i, " ".join(v)), (2 * i + 1, " ".join(edited(v, 7)))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    words = {i: neardup.Shingler().words(neardup.words_of(t)) for i, t in rows}
    root = {i: i for i in got}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in root:
        for b in root:
            if a < b and neardup.similarity(words[a], words[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: find(i) for i in root}
    assert len(set(want.values())) > 30 and all(want[2 * i] == want[2 * i + 1] for i in range(60))
    assert got == want


def test_added_tokens_are_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        own = tokenfile.Encoder(f.read())
    library = Tokenizer.from_file(path)
    assert 50256 in library.encode("a <|endoftext|> b", add_special_tokens=False).ids
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "plain words", ""):
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_passage_shifted_within_an_unspaced_run(spark):
    rng = random.Random(3)
    passage = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300))
    df = spark.createDataFrame([(passage, "中" + passage), ("ab" + passage[:40], "ไทย。" + passage[:40])], "a string, b string")
    a, b = (winnow.hashes(winnow.marks(F.col(c))) for c in "ab")
    first, second = df.select(winnow.likeness(a, b).alias("near")).collect()
    assert first.near > 0.9 and second.near > 0


def test_snapshots_numbered_otherwise(spark):
    say = lambda i: ("user", f"t{i}")
    rows = [(1, i, *say(i)) for i in range(1030)]  # the log, from 0
    rows += [(2, i + 1, *say(i)) for i in range(1026)]  # from 1
    rows += [(3, 2000 * i, *say(i)) for i in range(5)]  # with gaps
    rows += [(4, 0, *say(0)), (4, None, *say(1))]  # the last without a number
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con, conversations = duckdb.connect(), df.toArrow()  # noqa: F841
    want = con.sql(chat.ORACLE_SQL)
    got = chat.render(df)
    cols = sorted(got.columns)
    assert sorted(str(tuple(r)) for r in got.select(cols).collect()) == sorted(map(str, want.select(*cols).fetchall()))
    assert {r.conv_id for r in got.collect()} == {1}
