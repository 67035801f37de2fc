"""Document fingerprints by winnowing.

A text's words are hashed, and each character of a script written without spaces and of a run
of more than ``LONGEST`` characters is a word. Every run of ``K`` words gets a rolling hash, the
cyclic polynomial of its words' hashes: each is turned by a bit more than the next, and all are
added bit by bit. (Its value is what rolling from the run before would give; built-in functions
carry nothing along an array, so its K terms are taken directly.) Of every window of ``W`` such
hashes the smallest is kept, the rightmost of equal ones, with its place. So two texts that share K + W - 1 words in a row share a
fingerprint, and its places say where. Everything is done by array functions in a row.

A hash of 36 bits and the place counted down in 27 bits make one long, so that the smallest
of a window is at the rightmost place among equal hashes. Likeness is the Jaccard
similarity of the sets of hashes.

neighbours() puts each text beside that of the next id without a global sort: rows are dealt
to ranges of the order of id, hash of the text and a hash of the row's place in the input, so
that no id and no text is too frequent for one, and each range also gets the first row of the range that follows.

Defined cases: texts of up to 2^27 words, a place's bits, are fingerprinted, and longer ones fail; a null text is empty and has an empty fingerprint; of two empty fingerprints
the likeness is 1, of an empty and another 0; texts of fewer than K words have one hash of
all of them; rows with equal ids follow by the hash of their
text, equal rows in any order; rows with a null id come last; the row after the last is the first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, order_bounds, order_bucket, parts_for, whole
from quarry.llm.rules import bind

K, W, LONGEST = 5, 8, 16
#: Scripts written without spaces, of which each character is a word: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han and their punctuation.
UNSPACED = r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{19E0}-\x{19FF}\x{2E80}-\x{312F}\x{31A0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFF}"
PLACES = 27
RANGE_BYTES = 4 << 20


def marks(text: Column, k: int = K, w: int = W) -> Column:
    """The kept (hash, place) pairs as longs, in the order of places."""
    last, run = F.lit((1 << PLACES) - 1), rf"[^\x20\x09-\x0D{UNSPACED}]"
    words = F.regexp_extract_all(text, F.lit(rf"[{UNSPACED}]|(?<!{run}){run}{{1,{LONGEST}}}+(?!{run})|{run}"), F.lit(0))
    turned = lambda h, n: F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n)) if n else h
    terms = lambda h, i: (turned(F.coalesce(F.get(h, i + j), F.lit(0)), k - 1 - j) for j in range(k))
    rolling = lambda h, i: reduce(lambda a, b: a.bitwiseXOR(b), terms(h, i))
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(0)))
    gram = lambda h, i: F.shiftrightunsigned(rolling(h, i), 64 - 63 + PLACES)
    packed = lambda h: F.transform(upto(F.size(h) - k), lambda i: F.shiftleft(gram(h, i), PLACES).bitwiseOR(F.when(i <= last, last - i).otherwise(F.raise_error(F.lit("too long a text")))))
    least = lambda g: F.array_distinct(F.transform(upto(F.size(g) - w), lambda i: F.array_min(F.slice(g, i + 1, w))))
    of = lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(
        bind(F.transform(ws, lambda x: F.xxhash64(x)), lambda h: bind(packed(h), least))
    )
    return bind(words, of)


def hashes(m: Column) -> Column:
    return F.array_distinct(F.transform(m, lambda x: F.shiftright(x, PLACES)))


def written(m: Column) -> Column:
    """The pairs as text: hash in hexadecimal, @, place."""
    place = lambda x: F.lit((1 << PLACES) - 1) - x.bitwiseAND(F.lit((1 << PLACES) - 1))
    return F.array_join(F.transform(m, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, PLACES))), F.lit("@"), place(x).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of hashes, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def neighbours(docs: DataFrame, columns, carry) -> DataFrame:
    """(doc_id, text, columns, next): ``columns`` are computed once a row, and ``next`` holds the columns ``carry`` of the next row."""
    own = {"_null": F.col("doc_id").isNull(), "_hash": F.xxhash64("text"), "_salt": F.xxhash64(F.monotonically_increasing_id())}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).withColumns(own)
    order = ["_null", "doc_id", "_hash", "_salt"]
    bounds = order_bounds(rows.select(*order), parts_for(rows, F.octet_length("text"), RANGE_BYTES))
    key = F.struct(*order)
    rows = rows.withColumn("bucket", order_bucket(key, "struct<_null: boolean, doc_id: bigint, _hash: bigint, _salt: bigint>", bounds)).withColumn("ghost", F.lit(0))
    heads = rows.groupBy("bucket").agg(F.min(key).alias("_head"))
    by = Window.partitionBy(F.lit(0)).orderBy("bucket")
    ahead = F.coalesce(F.lag("bucket").over(by), F.max("bucket").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("bucket").alias("_b"), "_head", ahead.alias("_ahead"))  # at most as many rows as there are ranges
    first = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("_b")) & (key == F.col("_head")))
    first = first.select(*order, "text", F.col("_ahead").alias("bucket"), F.lit(1).alias("ghost"))
    dealt = rows.unionByName(first).repartition("bucket").sortWithinPartitions("bucket", "ghost", *order)
    made = dealt.withColumns(columns)
    after = F.lead(F.struct(*carry)).over(Window.partitionBy("bucket").orderBy("ghost", *order))
    return made.withColumn("next", after).where("ghost = 0").select("doc_id", "text", *columns, "next")


def op4_winnow(spark: SparkSession, folder: str) -> DataFrame:
    rows = neighbours(documents(spark, folder), {"marks": marks(F.col("text")), "n_chars": F.length("text").cast("long")}, ["text", "marks"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "marks", marks(F.col("edited")).alias("edited_marks"), F.col("next.marks").alias("next_marks")
    )
    rows = rows.withColumns({"own": hashes(F.col("marks")), "other": hashes(F.col("edited_marks")), "following": hashes(F.col("next_marks"))})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("marks")).alias("fingerprint"),
        written(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


QUERIES = {"op4_winnow": op4_winnow}
ORACLES: dict = {}
