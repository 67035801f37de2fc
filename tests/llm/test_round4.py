"""Findings of round 3."""

import random

from quarry.llm import bpe, neardup, substrings


def test_no_candidate_pair_of_two_classes_is_left_out(spark):
    """Versions of one text, many just below the threshold: pairs that share an entry and are similar meet, though neither is near a hub."""
    rng = random.Random(23)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for _ in range(300):
        w = list(base)
        for at in rng.sample(range(60), rng.randrange(4, 7)):
            w[at] = f"v{rng.randrange(10**9)}"
        rows.append(w)
    # far from all the others but for a twin; they share a few entries with many
    for _ in range(60):
        w = list(base)
        for at in range(rng.randrange(20, 25), 60):
            w[at] = f"v{rng.randrange(10**9)}"
        twin = list(w)
        for at in rng.sample(range(60), 5):
            twin[at] = f"v{rng.randrange(10**9)}"
        rows += [w, twin]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id int, text string")).collect()}
    hashed = [neardup.Shingler().words(w) for w in rows]
    entries = [neardup.sketch(neardup.Shingler.shingles(v)) for v in hashed]
    least = [neardup.minima(v) for v in hashed]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(rows)):
        for a in range(b):
            if (entries[a] == entries[b]).any() and (least[a] == least[b]).sum() >= neardup.ALIKE and neardup.similarity(hashed[a], hashed[b]) >= neardup.SIMILAR:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: find(i) for i in range(len(rows))}
    assert {i: (got[i], want[i]) for i in got if got[i] != want[i]} == {}
    assert 40 < len(set(got.values()))


def test_requests_and_answers_are_small():
    rng = random.Random(3)
    for size in (0, 1, 255, 256, 1 << 16, 1 << 17):
        words = sorted({b"", b"a" * size, b"a" * (size + 1), b"a" * 300 + b"b", "\u00e9".encode()})
        assert bpe.unpack(bpe.pack(words)) == bpe.unpack(bpe.pack(words, True)) == words
    assert bpe.unpack(bpe.pack([], True)) == bpe.unpack(bpe.pack([])) == []
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]
    words = sorted({(" " + "".join(rng.choices(syllables, k=rng.randrange(1, 5)))).encode() for _ in range(20_000)})
    assert len(bpe.pack(words, True)) < 0.29 * sum(map(len, words))  # 0.53 before


def test_pieces_with_no_other_of_their_key_go_before_the_join(spark):
    """A key of one piece isn't joined to anything; all others are."""
    rows = [(0, 0, 1, 1, 10), (1, 0, 1, 1, 11), (2, 0, 1, 2, 10), (3, 0, 1, 3, 12), (4, 0, 1, 3, 12), (5, 0, 2, 1, 10)]
    pieces = spark.createDataFrame(rows, "row long, place int, gram long, key long, kind long")
    kinds, keys = substrings._kinds(pieces)
    assert {(r.gram, r.key) for r in keys.collect()} == {(1, 1), (1, 3)}
    got = {(r.row, r.n, r.chosen, r.crowd) for r in substrings._judged(pieces, kinds, keys).collect()}
    assert got == {(0, 1, True, False), (1, 1, True, False), (3, 2, False, False), (4, 2, False, False)}
