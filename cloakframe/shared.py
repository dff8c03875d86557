"""Shared storage and join helpers used by several operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast only below both limits, which are checked on it.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
# A key with more than this share of all rows is spread over SALTS tasks.
HOT_SHARE = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless their path already has it."""
    package = Path(__file__).resolve().parent
    known = [os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    context = spark.sparkContext
    if str(package.parent) in known or getattr(context, "_sent_package", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._sent_package = True


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the session names it.

    A session inside one process (tests) gets a temporary folder if it names
    none; a cluster without one is an error, because a machine's own folder
    would not survive the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="cloakframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_OPEN: list[list[str]] = []


def staging_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written by ``cut`` inside the block are removed at its end, also after an error.

    For jobs that have written all their outputs by then: staged hits and
    values are raw personal data and must not stay behind.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete_path(spark, path)


def in_scratch() -> bool:
    """Whether what ``cut`` writes now will be removed."""
    return bool(_OPEN)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there.

    Used where later steps need exactly the rows and generated ids an earlier
    one saw, also after an executor is lost.  Unlike a checkpoint the written
    table is read column by column, and its size is known to the planner.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salt: Column,
                how: str = "left", row_bytes: int = 256) -> DataFrame:
    """Join a large table with a lookup table that has one row per key.

    The lookup side is counted.  Small enough, it is broadcast; otherwise both
    sides are shuffled on the key plus a salt, so one key that holds a large
    part of ``left`` is spread over ``SALTS`` tasks.
    """
    limit = min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes)
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), list(keys), how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        left.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
        .join(salted, [*keys, "_salt"], how)
        .drop("_salt")
    )


def join_many_to_one(many: DataFrame, one: DataFrame, key: str, salt: Column) -> DataFrame:
    """Join rows that may pile up on a few keys with a large table of one row per key.

    ``many`` is written once, so counting and joining do not run what made it
    again, and its bytes are known.  Few enough rows and bytes are broadcast, so
    the large table is not shuffled.  Otherwise keys that hold more than 1/1000
    of the rows each (at most 1000 keys) are salted, each over as many tasks as
    its share needs: their rows are spread by ``salt`` and only their partners
    are copied.
    """
    many = cut(many, "many")
    size = many.agg(F.count("*").alias("rows"), F.sum(sum(
        (F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16 for f in many.schema), F.lit(0))).alias("bytes")).first()
    if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return one.join(F.broadcast(many), key)
    share = max(1, size["rows"] // HOT_SHARE)
    hot = F.broadcast(many.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > share).select(
        key, F.ceil(F.col("_n") / share).cast("int").alias("_salts")))
    spread_many = many.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(salt, F.col("_salts")).cast("int")).otherwise(0)).drop("_salts")
    copied_one = one.join(hot, key, "left").withColumn("_salt", F.explode(F.when(
        F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0))))).drop("_salts")
    return copied_one.join(spread_many, [key, "_salt"]).drop("_salt")
