"""Plain texts, SQL dumps and page texts: one row per whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_unicode
from ..operators.records import texts_from
from .files import FILE_PATH, any_case, spread

# Pages are first joined in runs of this many, so a document with very many
# pages reaches its last task as a few long pieces.
PAGE_RUN = 1_000


def unix_newlines(text: Column) -> Column:
    """Line ends as text mode reads them."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def load_text(spark: SparkSession, path: str, suffix: str = "txt") -> DataFrame:
    """Whole text files; statements of a ``.sql`` dump are text like any other."""
    frame = spark.read.option("pathGlobFilter", any_case(suffix)).text(path, wholetext=True)
    return texts_from(spread(frame.select(F.col(FILE_PATH).alias("p"), "value")), F.col("p"), unix_newlines(F.col("value")))


def load_sql_dump(spark: SparkSession, path: str) -> DataFrame:
    return load_text(spark, path, "sql")


def assemble_pages(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """Text of every document from its extracted pages: ``doc, text``.

    Pages are joined by a newline in page order; null and empty pages are left
    out; the whole is stripped.  A document without any text keeps its row.
    """
    piece = F.when(F.col(text) != "", F.struct(F.col(page_no).alias("at"), F.col(text).alias("text")))
    runs = (
        pages.groupBy(F.col(doc), F.floor(F.col(page_no) / PAGE_RUN).alias("_run"))
        .agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
        .select(doc, "_run", F.when(F.size("_pieces") > 0, F.array_join(
            F.transform("_pieces", lambda p: p["text"]), "\n")).alias("text"))
    )
    joined = runs.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(
        F.col("text").isNotNull(), F.struct("_run", "text")))).alias("_runs"))
    return joined.select(doc, strip_unicode(
        F.array_join(F.transform("_runs", lambda r: r["text"]), "\n")).alias("text"))
