"""Writing sanitized outputs and reports.

One job writes the outputs of all sources of a format: rows are partitioned by
output name and source, so ``<dir>/output_file=<name>/source=<key>/part-*``
holds one source.  Rows are not shuffled for it.  A source that is written
again replaces its earlier output; outputs of other sources stay.  A run that
ends at any point leaves its folder's old output or the new one (``recover``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import is_text
from ..rules import INPUT_FORMATS
from ..shared import delete_path
from ..sources.files import report_name, sanitized_name, source_key

BY = ["output_file", "source"]


def _partitions(spark: SparkSession, path: str) -> list[str]:
    """Partition folders of two levels below ``path``, relative to it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "*=*/*=*"))
    return ["/".join(str(s.getPath().toString()).rsplit("/", 2)[1:]) for s in found or []]


class Replacement:
    """New partitions of an output folder that take the place of old ones, all or none.

    They are written beside the old ones, into a folder readers do not see.
    Then a journal names the partitions to put in and to take out; writing it is
    the one step that decides.  What it says is carried out by several threads,
    and again by ``recover`` if a run ended in between: until the journal is
    complete the old output stands, afterwards the new one can only be
    finished.  Every step may be repeated.
    """

    THREADS = 32

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.name = spark, path.rstrip("/"), uuid.uuid4().hex
        self._of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def new_path(self, name: str | None = None) -> str:
        return f"{self.path}/_new-{name or self.name}"

    def journal(self, name: str | None = None) -> str:
        return f"{self.path}/_journal-{name or self.name}"

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._of(path))

    def decide(self, gone: Iterable[str] = ()) -> None:
        """Write the journal: partitions that were written, and those of ``gone`` that were not."""
        made = _partitions(self.spark, self.new_path())
        rows = [("put", p) for p in made] + [("drop", p) for p in sorted(set(gone) - set(made))]
        self.spark.createDataFrame(rows, "step string, part string").write.json(self.journal())

    def carry_out(self, name: str | None = None) -> None:
        new, journal = self.new_path(name), self.journal(name)

        def step(row) -> None:
            fresh, old = self._of(f"{new}/{row['part']}"), self._of(f"{self.path}/{row['part']}")
            if row["step"] == "drop":
                self._fs.delete(old, True)
            elif self._fs.exists(fresh):  # else it is in its place already
                self._fs.delete(old, True)
                self._fs.mkdirs(old.getParent())
                if not self._fs.rename(fresh, old):
                    raise OSError(f"could not move {fresh.toString()}")

        with ThreadPoolExecutor(self.THREADS) as pool:
            for _ in pool.map(step, self.spark.read.schema("step string, part string").json(journal).toLocalIterator()):
                pass
        self._fs.delete(self._of(journal), True)
        self._fs.delete(self._of(new), True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish the replacements that earlier runs decided, and remove what they left undecided."""
    work = Replacement(spark, path)
    if not work.exists(work.path):
        return
    names = [s.getPath().getName() for s in work._fs.listStatus(work._of(work.path))]
    for name in [n.removeprefix("_journal-") for n in names if n.startswith("_journal-")]:
        if work.exists(f"{work.journal(name)}/_SUCCESS"):
            work.carry_out(name)
        else:
            delete_path(spark, work.journal(name))
    for name in names:
        if name.startswith("_new-"):
            delete_path(spark, f"{work.path}/{name}")


def _save(df: DataFrame, path: str, by: list[str] | None, write: Callable[[DataFrameWriter, str], None],
          gone: Callable[[], Iterable[str]] | None = None) -> None:
    """Write ``df``; whole folders are replaced, or with ``by`` the partitions that ``df`` has rows for and those of ``gone``."""
    spark = df.sparkSession
    if not by:
        write(df.write.mode("overwrite"), path)
        return
    recover(spark, path)
    if not _partitions(spark, path):  # nothing to replace
        write(df.write.mode("append").partitionBy(*by), path)
        return
    work = Replacement(spark, path)
    write(df.write.partitionBy(*by), work.new_path())
    work.decide(gone() if gone else ())
    work.carry_out()


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV with a header; absent values are empty."""
    _save(df, path, by, lambda w, p: w.options(
        header=True, quote='"', escape='"', nullValue="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(p))


def write_json(df: DataFrame, path: str, by: list[str] | None = None,
               gone: Callable[[], Iterable[str]] | None = None) -> None:
    """One JSON object per line, null fields included."""
    _save(df, path, by, lambda w, p: w.option("ignoreNullFields", "false").json(p), gone)


def write_text(df: DataFrame, path: str, by: list[str] | None = None, apart: bool = False) -> None:
    """Whole texts; the writer ends every text with a newline, so one that has it already gives it up.

    ``apart`` gives every text a file, all in one folder: folders of their own would be more to make and to list.
    """
    _save(df.select(*(by or []), F.regexp_replace("value", "\n\\z", "").alias("value")), path, by,
          lambda w, p: (w.option("maxRecordsPerFile", 1) if apart else w).text(p))


def write_sanitized(sanitized: DataFrame, input_format: str, mode: str, path: str) -> None:
    """Sanitized records of one format, one folder per source.

    JSON records that are texts go out as such, an object per line, in part
    files that the writer calls ``.txt``.
    """
    # The writer groups a task's rows by output file anyway; the record order comes with the same sort.
    named = sanitized.withColumn("output_file", sanitized_name(F.col("source_id"), mode)) \
        .withColumn("source", source_key(F.col("source_id"))).sortWithinPartitions(*BY, "record_index")
    if input_format == "csv":
        write_csv(named.select(*BY, "content.*"), path, BY)
    elif input_format == "json" and is_text(named.schema["content"].dataType):  # JSON texts are written as they are
        _save(named.select(*BY, "content"), path, BY, lambda w, p: w.text(p))
    elif input_format == "json":
        write_json(named.select(*BY, "content.*"), path, BY)
    elif input_format in ("txt", "pdf", "sql"):
        write_text(named.select(*BY, F.col("content").alias("value")), path, BY)
    else:
        raise ValueError(f"Unsupported output format: {input_format}; one of {', '.join(INPUT_FORMATS)}")


def write_report(rows: DataFrame, mode: str, path: str, report_format: str = "json", sources: DataFrame | None = None) -> None:
    """Report or listing rows (with ``source_id``) as JSON lines, one folder per source, null fields included.

    ``sources`` names all sources of the run: what an earlier run left for one
    that has no rows now is removed.
    """
    by = ["report", "source"]

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("report", report_name(F.col("source_id"), mode, report_format)) \
            .withColumn("source", source_key(F.col("source_id")))

    def gone() -> Iterator[str]:
        escape = sources.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in named(sources).select(*by).distinct().toLocalIterator():  # one row per source
            yield f"report={escape(row['report'])}/source={row['source']}"

    write_json(named(rows), path, by, gone if sources is not None else None)
