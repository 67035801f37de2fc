"""What several of the operators share."""

from __future__ import annotations

import gc
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, everywhere here: a run of anything but ASCII white space. Understood alike by Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
#: Bytes after which lean() gives memory back.
LEAN = 256 << 10


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def whole(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def scratch(spark: SparkSession) -> str:
    """A new folder below the one all executors share; a folder of our own only in a local session where none is set, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set: a folder that driver and executors share is needed")
        top = tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/quarry-{uuid.uuid4().hex}"


#: The paths that settle() has written, for each open workspace of a thread.
_WORK = threading.local()


@contextmanager
def workspace(spark: SparkSession) -> Iterator[list[str]]:
    """Gives the list of the paths that settle() writes within; if what is done within fails, all are deleted."""
    held = _WORK.__dict__.setdefault("held", [])
    held.append(made := [])
    try:
        yield made
    except BaseException:
        for path in made:
            with suppress(Exception):
                delete(spark, path)
        raise
    finally:
        held.pop()
        if held:
            held[-1].extend(made)


def tidy(query):
    """A query that leaves no tables behind if it fails."""

    @wraps(query)
    def run(spark: SparkSession, *args, **kwargs):
        with workspace(spark):
            return query(spark, *args, **kwargs)

    return run


def settle(df: DataFrame) -> DataFrame:
    """Write and reread: cuts the lineage, is read by several consumers, and outlives any executor."""
    path = scratch(df.sparkSession)
    for made in _WORK.__dict__.get("held", [])[-1:]:
        made.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame, sweep: bool = True) -> None:
    """Deletes settled tables of which all readers are done, and, to ``sweep``, has Spark's cleaner look for shuffles that nothing refers to any more."""
    for t in (t for t in tables if t is not None):
        delete(spark, t._settled_at)
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., list[Column]]]:
    """``docs`` with all columns but ``own`` under other names, so that none can clash with an operator's; and what gives the columns back, save some."""
    names = {c: f"_aside{i}" for i, c in enumerate(docs.columns) if c not in own}
    return docs.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns)), lambda *made: [F.col(names.get(c, c)).alias(c) for c in docs.columns if c not in made]


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or one made of it that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; an id that is null counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def order_bounds(keys: DataFrame, parts: int) -> list[str]:
    """At most ``parts`` - 1 ascending cut points of the rows' order, all columns one after the other, as JSON for order_bucket().

    They are the quantiles of about 64 rows a part, taken by a hash of all columns, so that no summary grows with the table; rows
    that differ in the last column only can be cut apart.
    """
    if parts < 2:
        return []
    share = F.xxhash64(*keys.columns).cast("double") / F.lit(2.0**64) + 0.5
    some = keys.where(share * keys.count() <= 64 * parts).select(F.struct(*keys.columns).alias("k"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("k")) - 1
    of = F.count("*").over(Window.partitionBy(F.lit(0)))
    nth = F.floor(rank * parts / of)
    cut = some.select("k", nth.alias("at")).groupBy("at").agg(F.min("k").alias("k")).where("at > 0")
    return [r["k"] for r in cut.select("at", F.to_json("k", {"ignoreNullFields": "false"}).alias("k")).orderBy("at").collect()]


def order_bucket(key: Column, kind: str, bounds: list[str]) -> Column:
    """Index of the range that holds the key, a struct of type ``kind``: two small searches, so that thousands of cut points stay cheap."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    text = lambda a: "[" + ",".join(a) + "]"
    first = F.from_json(F.lit(text([r[0] for r in rows])), f"array<{kind}>")
    table = F.from_json(F.lit(text([text(r) for r in rows])), f"array<array<{kind}>>")
    below = lambda a: F.size(F.filter(a, lambda b: b <= key))
    row = below(first)
    return F.when(row == 0, 0).otherwise((row - 1) * step + below(F.get(table, F.greatest(row - 1, F.lit(0)))))


def parts_for(df: DataFrame, size: Column, each: int, most: int = 65536) -> int:
    """How many parts of about ``each`` units the rows make; more than ``most`` only makes the parts larger."""
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    return int(min(most, max(1, -(-total // each))))


def give_back() -> None:
    """Has a worker process give back to the system the memory that it doesn't hold any more."""
    import ctypes

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library may be another than glibc
        trim(0)


def lean(run):
    """A function over batches that calls give_back() at the end of each task by which its worker has passed on ``LEAN`` bytes since the last call."""

    def task(batches):
        passed = memo("lean", lambda: [0])

        def counted(them):
            for batch in them:
                passed[0] += batch.nbytes
                yield batch

        try:
            yield from counted(run(counted(batches)))
        finally:
            if passed[0] >= LEAN:
                passed[0] = 0
                give_back()

    return task


def memo(key, make):
    """What ``make`` gives, once for a worker process; functions that are sent to workers lose module variables after each task."""
    store = sys.__dict__.setdefault("_quarry_memo", {})
    if key not in store:
        store[key] = make()
    return store[key]
