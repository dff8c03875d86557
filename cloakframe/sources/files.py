"""File names: formats, listings of a folder, output names."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import INPUT_FORMATS

FILE_PATH = "_metadata.file_path"


def infer_format(path: str, supported: Iterable[str] = INPUT_FORMATS) -> str:
    """Input format of one path, from its suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, suffix = name.rpartition(".")
    if not dot or not stem or not suffix:
        raise ValueError(f"Input file has no extension: {path}")
    if suffix.lower() not in supported:
        raise ValueError(
            f"Unsupported input format '{suffix.lower()}'. Supported formats: {', '.join(sorted(supported))}")
    return suffix.lower()


def file_name(path: Column) -> Column:
    """Last path part; percent escapes, as file listings write them, are undone."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit("%")), F.coalesce(
        F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)).otherwise(name)


def format_of(path: Column) -> Column:
    """Lower-case suffix without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^/]\.([^./]+)$", 1))


def _suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"[^/](\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(_suffix(path)))


def sanitized_name(path: Column, mode: str) -> Column:
    """``<stem>_<mode>_sanitized<suffix>``; page text goes to a ``.txt``."""
    suffix = F.lower(_suffix(path))
    return F.concat(stem(path), F.lit(f"_{mode}_sanitized"),
                    F.when(suffix == ".pdf", F.lit(".txt")).otherwise(suffix))


def source_key(path: Column) -> Column:
    """Short name of a source that keeps outputs of equally named files apart."""
    return F.lower(F.hex(F.xxhash64(path)))


def report_name(path: Column, mode: str, report_format: str = "json") -> Column:
    """``<stem>_<mode>_report.<format>``."""
    return F.concat(stem(path), F.lit(f"_{mode}_report.{report_format}"))


def any_case(suffix: str) -> str:
    """Glob for a suffix in either case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def list_files(spark: SparkSession, path: str, formats: Iterable[str] = INPUT_FORMATS) -> DataFrame:
    """``source_id, input_format`` of the supported files in a folder (not below it).

    Only names are listed; no file is opened.  Files of zero bytes, which
    readers skip, are listed as well.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().toUri().toString() for s in system.listStatus(root) if s.isFile()]
    # Readers name local files with a single slash.
    names = [(f.replace("file:///", "file:/", 1),) for f in found if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
    return (
        spark.createDataFrame(names, "source_id string")
        .withColumn("input_format", format_of(F.col("source_id")))
        .filter(F.col("input_format").isin(*formats))
    )


def plain_path(source_id: str) -> str:
    """The path to open for a listed ``source_id``."""
    return unquote(source_id)


def bare_path(path: str) -> str:
    """A listed path with one slash after its scheme; readers spell local files with one or three."""
    return re.sub(r"\A(\w+:)/{2,3}(?=[^/])", r"\1/", path)


def spread(frame: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of files that cannot be split, dealt to all cores if the files keep less than half of them busy.

    For a frame that comes straight from a reader: its number of tasks is
    planned without running anything.  Files that can be split are split finer
    than that unless they are small, so only work is moved that would wait.
    Rows stay in the order of a column, if one is named.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if 2 * frame.rdd.getNumPartitions() > cores:
        return frame
    return frame.repartition(cores) if order is None else frame.repartitionByRange(cores, order).sortWithinPartitions(order)
