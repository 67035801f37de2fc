"""Alignment of two tokenizers: where tokens of both end, and which ids stand together there.

Tokenizer A reads a space and the text, tokenizer B the text, before which it puts a space
itself, so that the tokens of both spell the same bytes. A task takes the documents of its
batches in slices of about ``SLICE_BYTES``: a slice is concatenated, with the byte offset of
each document; the ends of all A tokens and of all B tokens are counted once by byte, and
where both counts are above nought the tokens are cut into groups. Documents end with a token
of both, so no group crosses them, and differences of prefix sums at their ends give what
belongs to each.

Counts of id pairs need the whole corpus. Slices make blocks of about ``BLOCK_BYTES``; a block
counts its links by id pair and keeps for each link the number of its pair, and is written.
Pairs are summed over blocks, the highest count of each B id is joined, and a block asks for
each of its pairs once: a pair in every document makes a row a block, not one a document,
and the answers, in the order of the block's pairs, are looked up by number. No table of pairs
is broadcast or collected.

A goes by ranks, where the order of its vocabulary is that of its merges and regular expression
engines agree on the text, else by its own library. B encodes the words of a slice that a
worker doesn't know yet at once, cut before each space that follows another character, if no
piece of B goes on from another character to a space. The bytes of all tokens are compared
with the text.

Defined cases: null and empty texts, and texts that the tokens of A or B don't spell, have no
tokens and nought in all columns; strings of special tokens in texts are ordinary text; repeated
rows are separate documents, all of which count; of the ids that are linked most with a B id all
count as best; a text longer than a slice or a block is one of its own and must fit a task; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, lean, memo, settle
from quarry.llm.pretokens import is_unsure
from quarry.llm.tokenfile import MEMORABLE, Encoder, byte_letters

SLICE_BYTES, BLOCK_BYTES, REMEMBER = 1 << 20, 8 << 20, 300_000
SPACED = "▁"
PAIR = 32  # bits of a B id in a pair


class Side:
    """A tokenizer: ``encode`` gives the ids of a space and each of some texts, ``table`` the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], table: list[bytes]):
        self.encode, self.table = encode, table
        self.sizes = np.array([len(b) for b in table], np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids as arrays, None where their bytes aren't those of a space and the text."""
        out = []
        for t, ids in zip(texts, self.encode(texts)):
            right = b"".join(map(self.table.__getitem__, array("I", ids))) == b" " + t.encode()
            out.append(np.frombuffer(ids, np.uint32) if right else None)
        return out


def byte_level(spec: str) -> Side:
    """Of a tokenizer of the tokenizers library that writes bytes as letters."""
    own, of = Encoder(spec, plain=True), {c: b for b, c in enumerate(byte_letters())}
    names = {i: t for t, i in own.library.get_vocab(with_added_tokens=True).items()}
    spell = lambda t: bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode()
    table = [spell(names.get(i, "")) for i in range(max(names) + 1)]
    quick = own.ranked()
    own.known = None  # of no use any more

    def one(text: str) -> bytes:
        return own.direct(text) if quick is None or is_unsure(text) else array("I", quick.encode_ordinary(text)).tobytes()

    return Side(lambda texts: [one(" " + t) for t in texts], table)


def pieces(model: bytes) -> Side:
    """Of a sentencepiece model that puts a space before texts."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    table = [bytes([int(t[3:-1], 16)]) if own.is_byte(i) else t.replace(SPACED, " ").encode() for i, t in enumerate(names)]
    raw = lambda texts: [array("I", i).tobytes() for i in own.encode(texts, num_threads=1)] if texts else []
    words, known = re.compile(r" +[^ ]+(?: +\Z)?| +").findall, {}  # spaces at the end go with the last word
    # words don't depend on each other if no piece goes on from another character to a space and nothing is changed before
    apart = not any(SPACED in t.lstrip(SPACED) for t in names) and own.normalize("  a \t b  ") == SPACED * 3 + "a" + SPACED + "\t" + SPACED + "b" + SPACED * 2

    def encode(texts: list[str]) -> list[bytes]:
        cut = [words(" " + t) if apart and SPACED not in t else None for t in texts]
        met = set(chain.from_iterable(c for c in cut if c is not None))
        new = met.difference(known)
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = met
        new = list(new)
        known.update(zip(new, raw([w[1:] for w in new])))
        whole = iter(raw([t for t, c in zip(texts, cut) if c is None]))
        out = [next(whole) if c is None else b"".join(map(known.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > MEMORABLE:
                del known[w]
        return out

    return Side(encode, table)


def _shown(n: int, *signs: bytes) -> np.ndarray:
    """For each sign and each number below n its decimal digits and the sign, in eight bytes; n is 10,000,000 at most."""
    return np.array([b"%d%b" % (i, s) for s in signs for i in range(n)], "S8").view(np.uint64).reshape(len(signs), n)


class Aligner:
    def __init__(self, spec: str, model: bytes):
        self.a, self.b = byte_level(spec), pieces(model)
        self.shown_a, self.shown_b = _shown(len(self.a.table), b",", b"|"), _shown(len(self.b.table), b",", b";", b"\n")

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """For each text its ids by both, or None if it has no tokens."""
        some = [i for i, t in enumerate(texts) if t]
        out: list = [None] * len(texts)
        for i, a, b in zip(some, *(own([texts[i] for i in some]) for own in (self.a, self.b))):
            out[i] = None if a is None or b is None else (a, b)
        return out

    def slice(self, both: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of documents with tokens: the number of links of each, their groups as text, and all links' pairs of ids."""
        a, b = (np.concatenate([x[i] for x in both]) for i in (0, 1))
        stop_a, stop_b = (np.cumsum([len(x[i]) for x in both]) for i in (0, 1))
        last_a, last_b = (np.cumsum(own.sizes[ids]) - 1 for own, ids in ((self.a, a), (self.b, b)))  # bytes, in all documents one after the other
        n_bytes = int(last_a[-1]) + 1
        cut = (np.bincount(last_a, minlength=n_bytes) > 0) & (np.bincount(last_b, minlength=n_bytes) > 0)
        closes_a, closes_b = cut[last_a], cut[last_b]
        upto_a, upto_b = (np.concatenate([[0], np.cumsum(c)]) for c in (closes_a, closes_b))  # groups closed before each token
        end_a, end_b = (np.concatenate([[0], np.flatnonzero(c) + 1]) for c in (closes_a, closes_b))  # tokens before each group
        pairs = a[closes_a].astype(np.int64) << PAIR | b[closes_b].astype(np.int64)
        kind_b = closes_b.astype(np.int8)
        kind_b[stop_b - 1] = 2
        shown = np.empty(len(a) + len(b), np.uint64)
        shown[np.arange(len(a)) + end_b[upto_a[:-1]]] = self.shown_a[closes_a.astype(np.int8), a]
        shown[np.arange(len(b)) + end_a[upto_b[:-1] + 1]] = self.shown_b[kind_b, b]
        groups = shown.tobytes().translate(None, b"\0").decode().split("\n")[:-1]
        return np.diff(upto_a[stop_a], prepend=0), groups, pairs


GROUPED = "block long, doc_id long, n_a long, n_b long, n_links long, groups string, links binary, pairs binary"


def grouped(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """A row a document: its tokens' numbers, groups as text (``a1,a2|b1;a3|b2``), and for each link the number of its pair.

    The first row of each block carries the block's different pairs of ids, in ascending order, and how often each is linked there.
    """
    shared = docs.sparkSession.sparkContext.broadcast((spec, model))  # of bounded sizes, as vocabularies are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, block = memo(("aligner", shared.value), lambda: Aligner(*shared.value)), TaskContext.get().partitionId() << 33
        names, n_a, n_b, n_links, texts, pairs, held = [], [], [], [], [], [], 0
        waiting, size = [], 0  # the slice

        def close():
            nonlocal size
            for got in (found := own.encode(waiting)):
                for n, i in ((n_a, 0), (n_b, 1)):
                    n.append(len(got[i]) if got else 0)
            both = [got for got in found if got]
            links, groups, new = own.slice(both) if both else ([], [], np.empty(0, np.int64))
            links, groups = iter(links), iter(groups)
            n_links.extend(int(next(links)) if got else 0 for got in found)
            texts.extend(next(groups) if got else "" for got in found)
            pairs.append(new)
            waiting.clear()
            size = 0

        def flush():
            nonlocal block, held
            close()
            known, where, count = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            ends = np.cumsum(n_links).tolist()
            links = [where[i:j].astype("<u4").tobytes() for i, j in zip([0, *ends], ends)]
            head = [known.astype("<i8").tobytes() + count.astype("<i8").tobytes(), *[None] * (len(names) - 1)]
            out = [[block] * len(names), names, n_a, n_b, n_links, texts, links, head]
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], "block doc_id n_a n_b n_links groups links pairs".split())
            for c in (names, n_a, n_b, n_links, texts, pairs):
                c.clear()
            block, held = block + 1, 0
            return out

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                waiting.append(t.as_py())
                names.append(d)
                size += len(waiting[-1] or "")
                held += len(waiting[-1] or "")
                if size >= SLICE_BYTES:
                    close()
                if held >= BLOCK_BYTES:
                    yield flush()
        if names:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), GROUPED)


def pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): how many links of a block hold a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1)):
                pair, n = np.frombuffer(p.as_buffer(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), b)), pa.array(pair), pa.array(n)], ["block", "pair", "n"])

    return blocks.where("pairs IS NOT NULL").select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best) of the corpus; best: no A id is linked more often with the B id."""
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    second = F.col("pair").bitwiseAND((1 << PAIR) - 1)
    top = counts.groupBy(second.alias("_b")).agg(F.max("count").alias("_top"))
    return counts.join(top, second == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_top")).alias("best"))


def align(docs: DataFrame, spec: str, model: bytes, shown: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document; ``shown`` makes of a text of groups what is kept of it."""
    blocks = settle(grouped(docs, spec, model).withColumn("groups", shown(F.col("groups"))))
    rows = pair_rows(blocks)
    answers = rows.select("block", "pair").join(pair_counts(rows), "pair")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        count, best = (right.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best"))
        links = np.frombuffer(b"".join(left.column("links").to_pylist()), "<u4")
        ends = np.cumsum(left.column("n_links").to_numpy())
        upto = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[links])])[ends], prepend=0)
        return left.drop_columns(["block", "links"]).append_column("n_best", pa.array(upto(best))).append_column("count_sum", pa.array(upto(count)))

    kept = blocks.select("block", "doc_id", "n_a", "n_b", "n_links", "groups", "links")
    kind = f"doc_id long, n_a long, n_b long, n_links long, groups {blocks.schema['groups'].dataType.simpleString()}, n_best long, count_sum long"
    out = kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, kind)
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups")


def op11_align(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    shown = lambda g: F.when(F.col("n_links") > 0, F.sha2(g, 256)).otherwise("")
    return align(documents(spark, folder), spec, model, shown).withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op11_align": op11_align}
ORACLES: dict = {}
