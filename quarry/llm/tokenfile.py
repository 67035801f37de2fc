"""Token ids in a binary file format of patched frames of reference.

Documents are encoded in ascending order of their ids and end with an end id. A file is a
Parquet folder, so that any store Spark writes to will do and a lost task is written anew;
its rows are segments, each a self-contained payload of whole documents:

    header       8 x uint32: magic, version, ids, block length, blocks, documents, exceptions, 0
    documents    int64 id, uint8 is-not-null, uint32 number of ids, each as one array
    blocks       uint32 minimum, uint8 width, uint16 number of exceptions, uint32 start of the packed bytes
    exceptions   uint8 place in the block, uint32 difference
    packed       for each block, differences to the block's minimum, most significant bit first

A block's width holds ``SHARE`` of its differences; the rest are exceptions, whose low bits
are packed all the same. The starts make a block readable alone.

Segments belong to shards, ranges of document ids, each written by one task in ascending order,
as one part file or more whose names ascend too; the start of a document in the whole file is
the sum of ids of the shards, of the segments, and of the documents before it.

Texts are cut into pre-tokens and each distinct pre-token goes through the tokenizers library
once for as long as a worker remembers it. A stretch on whose characters regular expression
engines may differ is one piece, and a text that holds the content of an added token such as
<|endoftext|> goes through the library as a whole.

Defined cases: a null text is empty and has only the end id; documents with equal ids follow
by a hash of their text, those with a null id come last; repeated rows are separate documents,
dealt to shards by their place in the input partitions; a very long text makes one large segment, as segments hold whole documents; an empty table
makes an empty file; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, lean, memo, parts_for, scratch, whole
from quarry.llm.pretokens import Cutter, is_unsure

MAGIC, VERSION, BLOCK, SHARE = 0x51504652, 1, 256, 0.9
SEGMENT_IDS, SHARD_BYTES, REMEMBER, MEMORABLE = 1 << 18, 8 << 20, 600_000, 256
SEGMENT = "shard int, segment int, n_docs int, n_ids long, payload binary"


def pack(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """A segment's payload."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    m = padded.reshape(blocks, BLOCK)
    low = m.min(axis=1, initial=0xFFFFFFFF) if blocks else np.empty(0, np.uint32)
    diff = m - low[:, None]
    at = int(SHARE * (BLOCK - 1))
    width = np.frexp(np.partition(diff, at, axis=1)[:, at].astype(np.float64))[1].astype(np.uint8) if blocks else np.empty(0, np.uint8)
    over = diff >> width[:, None].astype(np.uint32) > 0
    over &= width[:, None] < 32
    rows, places = np.nonzero(over)
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(width.astype(np.int64) * (BLOCK // 8), out=starts[1:])
    packed = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width[width > 0]):
        w = int(w)
        which = np.flatnonzero(width == w)
        kind, bits = (">u2", 16) if w <= 16 else (">u4", 32)
        part = (diff[which] & np.uint32((1 << w) - 1)).astype(kind).view(np.uint8).reshape(-1, bits // 8)
        part = np.packbits(np.unpackbits(part, axis=1)[:, bits - w :].reshape(len(which), BLOCK * w), axis=1)
        packed[starts[which][:, None] + np.arange(w * BLOCK // 8)] = part
    has = np.array([d is not None for d in doc_ids], np.uint8)
    head = np.array([MAGIC, VERSION, n, BLOCK, blocks, len(doc_ids), len(rows), 0], "<u4")
    return b"".join(
        x.tobytes()
        for x in (
            head,
            np.array([d or 0 for d in doc_ids], "<i8"),
            has,
            np.array(lengths, "<u4"),
            low.astype("<u4"),
            width,
            np.bincount(rows, minlength=blocks).astype("<u2"),
            starts[:-1].astype("<u4"),
            places.astype(np.uint8),
            diff[rows, places].astype("<u4"),
            packed,
        )
    )


class Segment:
    """Reads a payload, whole or a block at a time."""

    def __init__(self, payload: bytes):
        head = np.frombuffer(payload, "<u4", 8)
        if len(payload) < 32 or head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a segment")
        self.n, self.block, blocks, docs, exceptions = (int(x) for x in head[2:7])
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        ids, has = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(d) if h else None for d, h in zip(ids, has)]
        self.lengths = take("<u4", docs)
        self.low, self.width, self.n_over, self.starts = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u4", blocks)
        self.over_at = np.concatenate([[0], np.cumsum(self.n_over, dtype=np.int64)])
        self.places, self.values = take("u1", exceptions), take("<u4", exceptions)
        self.packed = np.frombuffer(payload, np.uint8, -1, at) if at < len(payload) else np.empty(0, np.uint8)

    def blocks(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), self.block), np.uint32)
        for w in np.unique(self.width[which]):
            w, mine = int(w), np.flatnonzero(self.width[which] == w)
            if w:
                raw = self.packed[self.starts[which[mine]].astype(np.int64)[:, None] + np.arange(w * self.block // 8)]
                bit = np.arange(self.block) * w
                byte, skip = bit >> 3, (bit & 7).astype(np.uint64)
                wide = np.zeros((len(mine), self.block), np.uint64)
                for k in range((w + 14) // 8):  # the bytes that a value may reach into
                    wide = (wide << np.uint64(8)) | raw[:, np.minimum(byte + k, raw.shape[1] - 1)]
                out[mine] = (wide >> (np.uint64(8 * ((w + 14) // 8) - w) - skip)) & np.uint64((1 << w) - 1)
        counts = self.n_over[which].astype(np.int64)
        if counts.sum():
            row = np.repeat(np.arange(len(which)), counts)
            source = np.repeat(self.over_at[which], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            out[row, self.places[source]] = self.values[source]
        return out + self.low[which][:, None]

    def ids(self) -> np.ndarray:
        return self.blocks(np.arange(len(self.low))).reshape(-1)[: self.n]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Words(dict):
    """Remembers words' ids in two generations, so that it stays small and frequent words stay known; not those of more than ``MEMORABLE`` characters."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > MEMORABLE:
            return self.make(word)
        if len(self) >= REMEMBER:
            self.old = dict(self)
            self.clear()
        out = self[word] = self.old.get(word) or self.make(word)
        return out


class Encoder:
    """Texts to ids, as the tokenizers library would by default: the content of an added token in a text is that token, or with ``plain`` ordinary text."""

    def __init__(self, spec: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = plain
        self.known = known = json.loads(spec)
        pre, model = known.get("pre_tokenizer") or {}, known.get("model") or {}
        usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_word = usual and model.get("type") == "BPE" and not known.get("normalizer")
        self.added = [t["content"] for t in known.get("added_tokens") or [] if not (plain and t.get("special"))]
        self.cutter, self.words, self.model = Cutter(), Words(self.word), self.library.model
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})

    def direct(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        if not self.by_word or is_unsure(word):
            return self.direct(word)
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def ranked(self):
        """The same encoding by ranks, if the ids of the vocabulary ascend as its merges do, all bytes come first and texts are cut by the public pattern."""
        import public_tokenizers
        import tiktoken

        model = self.known.get("model") or {}
        vocabulary, merges = model.get("vocab") or {}, model.get("merges") or []
        made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
        letters = {c: b for b, c in enumerate(byte_letters())}
        usual = not model.get("ignore_merges") and not model.get("dropout") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
        if not self.by_word or not usual or self.added or made != list(range(256, 256 + len(made))) or {vocabulary.get(c, 256) for c in letters} != set(range(256)):
            return None
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if i < 256 + len(made)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def cut(self, text: str) -> list[str] | None:
        """The pieces that word() encodes; none if the text goes through the library as a whole."""
        return self.cutter(text) if self.by_word and not any(a in text for a in self.added) else None

    def __call__(self, text: str) -> bytes:
        pieces = self.cut(text)
        return self.direct(text) if pieces is None else b"".join(map(self.words.__getitem__, pieces))


def encode_segments(docs: DataFrame, spec: str, end: int = 0) -> DataFrame:
    """Segments of all documents. ``spec``: the tokenizer's JSON, which has a bounded size, as its vocabulary has."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    n = parts_for(rows, F.octet_length("text"), SHARD_BYTES)
    order = [F.asc_nulls_last("doc_id"), "hash", "nth"]  # the hash splits a hot id, the number equal rows, and ranges of them are cheap to sample
    rows = rows.withColumns({"hash": F.xxhash64("text"), "nth": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    shared, tail = docs.sparkSession.sparkContext.broadcast(spec), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = memo(("encoder", shared.value), lambda: Encoder(shared.value))
        shard = TaskContext.get().partitionId()  # ranges ascend with it
        segment, ids, names, lengths, held = 0, [], [], [], 0

        def flush():
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = ([shard], [segment], [len(names)], [len(flat)], [pack(flat, names, lengths)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["shard", "segment", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if names and held >= SEGMENT_IDS:
                    yield flush()
                    segment, ids, names, lengths, held = segment + 1, [], [], [], 0
                got = encode(t.as_py()) + tail
                ids.append(got)
                names.append(d)
                lengths.append(len(got) // 4)
                held += lengths[-1]
        if names:
            yield flush()

    return rows.mapInArrow(lean(run), SEGMENT)


def write(docs: DataFrame, path: str, spec: str, end: int = 0) -> None:
    encode_segments(docs, spec, end).write.option("compression", "none").parquet(path)


def starts(segments: DataFrame) -> DataFrame:
    """(shard, segment, before): the ids before each segment. Reads no payload; one task sees a row a shard, of which there is a bounded number."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("n")).alias("base"))
    inner = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    rows = segments.select("shard", "segment", inner.alias("inner")).join(shards, "shard")
    return rows.select("shard", "segment", (F.col("inner") + F.col("base")).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of a file: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENT).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, payload in zip(*(batch.column(i) for i in range(3))):
                s = Segment(payload.as_py())
                raw, ends = s.ids().astype("<u4").tobytes(), np.cumsum(s.lengths, dtype=np.int64)
                begins = ends - s.lengths
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends)]
                k = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.as_py()] * k, pa.int32()),
                        pa.array([segment.as_py()] * k, pa.int32()),
                        pa.array(s.doc_ids, pa.int64()),
                        pa.array(begins, pa.int64()),
                        pa.array(s.lengths.astype(np.int64)),
                        pa.array(sums, pa.int64()),
                    ],
                    ["shard", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    docs = segments.select("shard", "segment", "payload").mapInArrow(lean(run), "shard int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    rows = docs.join(starts(segments.drop("payload")), ["shard", "segment"])
    return rows.select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op10_tokenfile(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = scratch(spark)
    write(documents(spark, folder), path, spec)
    return read(spark, path)


QUERIES = {"op10_tokenfile": op10_tokenfile}
ORACLES: dict = {}
