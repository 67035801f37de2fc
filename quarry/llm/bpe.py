"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are dealt to chunks of about ``CHUNK_BYTES``. Each chunk asks for its distinct pre-tokens,
dealt by their hash to desks: all requests for a word meet at one desk,
which encodes it once and answers every chunk. Desks grow with the root of the number of chunks,
so that neither the words of a desk nor the requests of a chunk become many. There the ids are put at the places at which
the pre-tokens stand in each text. A word that every document holds is asked for once a
chunk, not once a document; a chunk's requests to a desk travel as one compressed row; and
the texts are shuffled once, since both uses of a chunk read the same exchange. (Giving every
occurrence a row of its own, with its position, moves several times the input; the places
are kept by the chunk instead.)

Decoding joins ids to the table of token bytes, which has as many rows as the vocabulary.

A stretch on whose characters regular expression engines may differ is a word of its own.

Defined cases: a null text is empty and has no ids; repeated rows are separate documents, dealt
to chunks by their place in the input partitions; a text longer than a chunk makes its chunk so
much larger, which must fit a task; an empty table gives an empty result; columns named ids or
decoded are replaced, others kept.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import documents, give_back, lean, memo, parts_for, whole
from quarry.llm.pretokens import Cutter

CHUNK_BYTES, PART_BYTES, DESKS = 8 << 20, 1 << 20, 4  # desks: so many times the root of the number of chunks
LEVEL = 6  # of compression of what chunks and desks exchange


def load_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}


def library_of(blob: bytes):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(blob), special_tokens={})


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pack(words: list[bytes], ascending: bool = False) -> bytes:
    """A list of byte strings in one; lengths apart, in as few bytes as they need; ``ascending`` ones less what each shares with the one before."""
    shared = bytearray()
    if ascending:
        last, rest = b"", []
        for w in words:
            k, most = 0, min(len(last), len(w), 255)
            while k < most and last[k] == w[k]:
                k += 1
            shared.append(k)
            rest.append(w[k:])
            last = w
        words = rest
    lengths = np.array([len(w) for w in words], np.uint32)
    width = int(np.searchsorted([1 << 8, 1 << 16], lengths.max(), side="right")) if len(words) else 0
    head = len(words).to_bytes(4, "little") + bytes([1 << width, ascending])
    return zstandard.compress(head + bytes(shared) + lengths.astype(f"<u{1 << width}").tobytes() + b"".join(words), LEVEL)


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n, width, ascending = int.from_bytes(raw[:4], "little"), raw[4], raw[5]
    at = 6 + n * ascending
    first = at + width * n
    ends = first + np.cumsum(np.frombuffer(raw, f"<u{width}", n, at), dtype=np.int64)
    words = [raw[i:j] for i, j in zip([first, *ends.tolist()], ends.tolist())]
    if ascending:
        for i in range(1, n):
            words[i] = words[i - 1][: raw[6 + i]] + words[i]
    return words


def requests(words: set[str], desks: int) -> dict[int, list[bytes]]:
    """Words by desk, in ascending order; an answer has the same order, and so needn't repeat them."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        w = w.encode()
        out.setdefault(zlib.crc32(w) % desks, []).append(w)
    return {d: sorted(out[d]) for d in sorted(out)}


def encode(docs: DataFrame, blob: bytes, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) with ids and decoded, the bytes that decoding the ids gives.

    ``blob``: the file of ranks, of bounded size, as a vocabulary has.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded") and (keep is None or f.name in keep)]
    names = ["_text" if f.name == "text" else f"c{i}" for i, f in enumerate(kept)]
    rows = docs.select(*(F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names) if n != "_text"), F.col("text").alias("_text"))
    chunks = parts_for(docs, F.octet_length(whole()), CHUNK_BYTES, 1 << 30)
    desks = min(chunks, math.ceil(DESKS * math.sqrt(chunks)))
    # by the place of a row, so that equal rows go to different chunks
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("long")).repartition("chunk")
    shared = docs.sparkSession.sparkContext.broadcast(blob)
    width = 2 if max(load_ranks(blob).values(), default=0) < 1 << 16 else 4  # bytes of an id that travels

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, chunk, words = Cutter(), None, set()

        def give():
            asked = requests(words, desks)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(asked), pa.int32()), pa.array([chunk] * len(asked), pa.int64()), pa.array([pack(w, True) for w in asked.values()], pa.binary())], ["desk", "chunk", "words"]
            )

        for batch in batches:
            text_at, chunk_at = batch.schema.get_field_index("_text"), batch.schema.get_field_index("chunk")
            for c, t in zip(batch.column(chunk_at).to_pylist(), batch.column(text_at)):
                if c != chunk:
                    if words:
                        yield give()
                    chunk, words = c, set()
                words.update(cut(t.as_py() or ""))
        if words:
            yield give()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = memo(("bpe", shared.value), lambda: library_of(shared.value))
        desk, known = None, {}
        for batch in batches:
            out = []
            for d, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if d != desk:
                    desk, known = d, {}
                ids = []
                for w in unpack(words):
                    if w not in known:
                        known[w] = array("H" if width == 2 else "I", library.encode_ordinary(w.decode())).tobytes()
                    ids.append(known[w])
                out.append(pack(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["desk", "chunk", "ids"])

    out_type = T.StructType([*(T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(kept)), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        cut, table = Cutter(), memo(("bytes", shared.value), lambda: {i: b for b, i in load_ranks(shared.value).items()})
        words, known, want = set(), {}, _arrow(out_type)
        for t in left.column("_text"):
            words.update(cut(t.as_py() or ""))
        asked = requests(words, desks)
        del words
        for desk, ids in zip(right.column("desk").to_pylist(), right.column("ids")):
            known.update(zip((w.decode() for w in asked.pop(desk)), unpack(ids.as_py())))

        def some(rows: pa.Table) -> pa.Table:
            raw, sizes, decoded = [], [], []
            for t in rows.column("_text"):
                one = b"".join(map(known.__getitem__, cut(t.as_py() or "")))
                raw.append(one)
                sizes.append(len(one) // width)
                decoded.append(b"".join(map(table.__getitem__, np.frombuffer(one, f"<u{width}").tolist())))
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            values = np.frombuffer(b"".join(raw), f"<u{width}").astype(np.int32)
            columns = [rows.column(n) for n in names]
            columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array(decoded, pa.binary())]
            return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, want)], names=want.names)

        # answers leave in parts, so that neither side holds lists of a whole chunk
        sizes, at, parts = np.cumsum([len(t.as_buffer() or b"") if t.is_valid else 0 for t in left.column("_text")]), 0, []
        while at < left.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, side="right")))
            parts.append(some(left.slice(at, end - at)))
            at = end
        known.clear()
        give_back()
        return pa.concat_tables(parts) if parts else some(left)

    asked = dealt.sortWithinPartitions("chunk").mapInArrow(lean(ask), "desk int, chunk long, words binary")
    answers = asked.repartition("desk").sortWithinPartitions("desk").mapInArrow(lean(answer), "desk int, chunk long, ids binary")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(place, out_type)
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)), "ids", "decoded")


def ranks_file(name: str = "byte_bpe_multi_50k.tiktoken") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def digests(rows: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, and digests of what encode() gives."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(encode(documents(spark, folder).select("doc_id", "text"), ranks_file(), ["doc_id"]))


QUERIES = {"op3_bpe": op3_bpe}
ORACLES: dict = {}
