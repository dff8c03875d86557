"""Rows of a SQL query as records."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import identifier
from ..operators.records import records_from


def source_label(url: str | None) -> str:
    """Report label of a database: the path of an SQLite file, else ``database``."""
    prefix = "sqlite:///"
    bare = (url or "").removeprefix("jdbc:")
    if bare.startswith(prefix) and bare != prefix:
        return urlsplit(bare).path.removeprefix("/") if "?" in bare else bare.removeprefix(prefix)
    return "database"


def key_ranges(key: str, bounds: Sequence[object]) -> list[str]:
    """Conditions of a database that part its rows by ``key`` at ``bounds`` (rising), rows without one last."""
    def spelled(value: object) -> str:
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        if isinstance(value, datetime.datetime):
            return f"{{ts '{value.isoformat(sep=' ')}'}}"
        return f"{{d '{value.isoformat()}'}}" if isinstance(value, datetime.date) else str(value)

    cuts = [spelled(b) for b in dict.fromkeys(bounds)]
    if not cuts:
        return [f"{key} IS NOT NULL", f"{key} IS NULL"]
    between = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{key} < {cuts[0]}", *between, f"{key} >= {cuts[-1]}", f"{key} IS NULL"]


def key_bounds(keys: DataFrame, parts: int) -> list[object]:
    """Values that part the only column of ``keys`` into about even ranges, from a sketch of all of them."""
    if parts < 2:
        return []
    name = keys.columns[0]
    kind = keys.schema[name].dataType
    known = keys.filter(F.col(name).isNotNull())
    if not isinstance(kind, T.StringType):
        shares = [i / parts for i in range(1, parts)]
        found = known.agg(F.percentile_approx(name, shares).alias("b")).first()["b"] or []
        return sorted(set(found))
    # Texts have no percentiles: of the values, those with the smallest hashes stand for all.
    drawn = sorted(r[0] for r in known.orderBy(F.xxhash64(name)).limit(100 * parts).collect())
    return sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []


def load_query(spark: SparkSession, query: str, url: str | None = None, key: str | None = None,
               options: Mapping[str, str] | None = None, split_by: str | None = None, parts: int | None = None) -> DataFrame:
    """Records of a query, run by Spark or, with ``url``, by a database over JDBC.

    ``key`` is a column that numbers the rows.  Without one they are numbered
    (``position``, see ``index_records``): in the order they arrive, or with
    ``split_by`` in the order of that column (nulls last, ties by the whole
    row), which gives equal numbers however the rows are read.  ``split_by``
    also lets a database be read in ``parts`` (default: one per core) key
    ranges at once; their bounds come from a sketch of the column, which is
    read first.  JDBC options such as ``partitionColumn`` can be given instead.
    """
    parts = parts or spark.sparkContext.defaultParallelism
    if url is None:
        rows = spark.sql(query)
    else:
        reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
        if split_by is None:
            rows = reader.option("dbtable", f"({query}) q").load()
        else:
            bounds = key_bounds(reader.option("dbtable", f"(SELECT {split_by} FROM ({query}) q) k").load(), parts)
            rows = spark.read.jdbc(url, f"({query}) q", predicates=key_ranges(split_by, bounds), properties=dict(options or {}))
    numbered = key is None
    if numbered and split_by is not None:
        order = [F.col(identifier(split_by)).asc_nulls_last(), F.to_json(F.struct(*[F.col(identifier(c)) for c in rows.columns]))]
        if url is None:
            rows = rows.repartitionByRange(parts, *order)
        rows = rows.sortWithinPartitions(*order)
    records = records_from(rows, source_label(url), key)
    return records if not numbered else records.withColumn("position", F.struct(
        F.spark_partition_id().cast("bigint").alias("block"), F.monotonically_increasing_id().alias("seq")))
