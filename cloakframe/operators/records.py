"""The one table shape every operator works on.

A source is a DataFrame with four columns:

``source_id``     STRING   file path, table name or any other source label
``record_index``  BIGINT   position or key of the record; null for a single document or a text
``units``         BIGINT   what the row adds to its source's record count
``content``       STRUCT for records, STRING for whole texts
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier
from ..shared import lookup_join

META = ("source_id", "record_index", "units")


def records_from(
    df: DataFrame,
    source_id: Column | str,
    key: Column | str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Give a table the record shape.

    ``source_id`` is a Column, or a plain string used as one label for the
    whole table.  ``key`` is the caller's integer row key; parquet rows have no
    position of their own.  ``columns`` are the fields to scan (default: all).
    """
    source = source_id if isinstance(source_id, Column) else F.lit(source_id)
    index = F.lit(None) if key is None else (F.col(key) if isinstance(key, str) else key)
    fields = list(columns) if columns is not None else df.columns
    return df.select(
        source.cast("string").alias("source_id"),
        index.cast("bigint").alias("record_index"),
        F.lit(1).cast("bigint").alias("units"),
        F.struct(*[F.col(identifier(c)).alias(c) for c in fields]).alias("content"),
    )


def texts_from(df: DataFrame, source_id: Column, text: Column | str) -> DataFrame:
    """Give whole texts (one row per text) the record shape."""
    return df.select(
        source_id.cast("string").alias("source_id"),
        F.lit(None).cast("bigint").alias("record_index"),
        F.lit(1).cast("bigint").alias("units"),
        (F.col(text) if isinstance(text, str) else text).alias("content"),
    )


def index_records(df: DataFrame) -> DataFrame:
    """Turn ``position`` into ``record_index``, the row's 0-based place in its file.

    ``seq`` grows within a file split.  The table of splits (one row each) gives
    every split its first index; rows are joined with it, never sorted.  A
    table without ``position`` is returned as it is, and a row with a null one
    keeps its index.
    """
    if "position" not in df.columns:
        return df
    before = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        df.filter("position is not null").groupBy("source_id", F.col("position.block").alias("block"))
        .agg(F.count("*").alias("_n"), F.min("position.seq").alias("_first"))
        .select("source_id", "block", (
            F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    joined = lookup_join(df.withColumn("block", F.col("position.block")), splits,
                         ["source_id", "block"], F.col("position.seq"))
    return joined.withColumn("record_index", F.coalesce(F.col("position.seq") + F.col("_shift"), F.col("record_index"))) \
        .drop("position", "block", "_shift")
