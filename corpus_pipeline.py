"""A corpus pipeline: language, near duplicates, repeated strings, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which is what its
predecessor kept; all but the last return the columns of documents.

- language: drops documents that have no letter or whose language can't be told; where no row
  teaches a language, only those without a letter
- near_duplicates: keeps one document of each class of near copies
- repeated_strings: cuts every string of 200 bytes that stands elsewhere too
- mixture: repeats and drops documents to meet the sources' targets; its table is in training
  order, part file by part file and row by row (it has the columns of documents, so no position)
- tokens: the place of each document in that order, read back from the files, and its ids and
  decoded bytes as digests; sorted by place, in ranges

Defined cases: a table that isn't read from files has the order of its partitions; texts of any
length are taken whole, in the memory that the operators' docstrings state; documents of equal
places in the mixture go by id; null texts and texts without a letter go in the first stage; a null id, language
or source stays; of equal rows one stays; a text that is cut to nothing stays as an empty one;
further columns of any names keep their values; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, neardup, substrings
from quarry.llm import language as lang_id
from quarry.llm.common import aside, delete, documents, remainder, settle, workspace

#: Below it, a language counts as not told; chance gives about a quarter for four languages.
LEAST_SCORE = 0.3


def keeps_columns(stage):
    """Further columns of docs go under other names while the stage works, so that none can clash with the operator's."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows, back = aside(docs, "doc_id", "text", "lang", "source", "n_chars")
        return stage(spark, rows, sf_dir).select(*back())

    return run_stage


@keeps_columns
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.fit(docs.where(remainder("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = lang_id.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))


@keeps_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_duplicates(docs)


@keeps_columns
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = substrings.cut(docs).withColumn("text", substrings.text())
    return rows.withColumn("n_chars", F.length("text").cast("long"))


@keeps_columns
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def placed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """doc_id and text with _file and _row, where each row stands; and what makes of these the place in the whole table, from 0, of any rows that carry them."""
    try:
        where = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "text", where["file_path"].alias("_file"), where["row_index"].alias("_row"))
        ends = docs.select(where["file_path"].alias("_f"))
    except AnalysisException:  # no files
        at = F.monotonically_increasing_id()
        rows = docs.select("doc_id", "text", F.shiftright(at, 33).alias("_file"), at.bitwiseAND((1 << 33) - 1).alias("_row"))
        ends = docs.select(F.shiftright(at, 33).alias("_f"))
    ends = ends.groupBy("_f").count()  # a row a file
    before = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_f")) - F.col("count")

    def place(made: DataFrame) -> DataFrame:
        files = ends.select("_f", before.alias("_before"))
        made = made.join(files, F.col("_file") == F.col("_f"))
        return made.withColumn("position", F.col("_before") + F.col("_row")).drop("_file", "_row", "_f", "_before")

    return rows, place


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, place = placed(docs)
    out = bpe.digests(bpe.encode(rows, bpe.ranks_file(), ["doc_id", "_file", "_row"]), "_file", "_row")
    return place(settle(out)).orderBy("position")  # written, as a sort reads its input twice


STAGES = [(f.__name__, f) for f in (language, near_duplicates, repeated_strings, mixture, tokens)]

#: Language models and aligned near copies are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    with workspace(spark):  # if a stage fails, nothing stays
        for _, stage in STAGES[:-1]:
            with workspace(spark) as made:
                docs = settle(stage(spark, docs, sf_dir))
            for path in {before, *made} - {docs._settled_at, None}:  # nothing reads these any more
                delete(spark, path)
            before = docs._settled_at
        return STAGES[-1][1](spark, docs, sf_dir)
