"""CSV files as records of string fields."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import identifier
from ..shared import ship
from .files import FILE_PATH, any_case, bare_path, plain_path, spread

_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8"}
# A file of more bytes is read by several tasks, also when quoted values hold line ends.
LARGE_FILE = 64 << 20
# Lines handed to Python at once while headers are read.
HEADER_LINES = 64


def _glob() -> dict[str, str]:
    return {"pathGlobFilter": any_case("csv")}


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def headers(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], list[str]]]:
    """Distinct headers and the files that have them: ``(field names, source ids)``.

    Every file is opened by a task of its own, which stops after the header
    record, so what is read does not grow with the files.  The result is as
    long as the file listing the Spark driver keeps for the same read.
    """
    ship(spark)

    def first(batches):
        held, source = [], None
        for batch in batches:
            for own, line in zip(batch.column("source_id").to_pylist(), batch.column("value").to_pylist()):
                source = own
                if held or line.strip("﻿ \t\r"):
                    held.append(line.rstrip("\r"))
                    if not still_open("\n".join(held)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([source], pa.string()), pa.array([header_names("\n".join(held))], pa.list_(pa.string()))], ["source_id", "names"])
                        return
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([source], pa.string()), pa.array([header_names("\n".join(held))], pa.list_(pa.string()))], ["source_id", "names"])

    # Files are not packed together and not split.
    whole = str(1 << 60)
    with _settings(spark, spark__sql__files__maxPartitionBytes=whole, spark__sql__files__openCostInBytes=whole,
                   spark__sql__execution__arrow__maxRecordsPerBatch=str(HEADER_LINES)):
        lines = spark.read.options(**_glob()).text(path).select(F.col(FILE_PATH).alias("source_id"), "value")
        found = lines.mapInArrow(first, "source_id string, names array<string>") \
            .groupBy("names").agg(F.array_sort(F.collect_list("source_id")).alias("ids")).collect()
    return sorted(((list(r["names"]), list(r["ids"])) for r in found), key=lambda g: g[0])


_QUOTED = re.compile('[^"]*(?:""[^"]*)*')


def still_open(text: str, inside: bool = False) -> bool:
    """Whether a quoted value is open at the end of a text that starts at a field, or inside a quoted one.

    A quote opens a value only as its first character; a value goes on after
    its closing quote until the next comma.
    """
    at = 0
    while True:
        if inside:
            at = _QUOTED.match(text, at).end()
            if at >= len(text):
                return True
            inside = False
        elif text.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = text.find(",", at) + 1
        if not at:
            return False


def header_names(text: str) -> list[str]:
    names = next(csv.reader([text.removeprefix("﻿")], strict=False), [""])
    return [*names] or [""]


def load_csv_groups(spark: SparkSession, path: str, listed: DataFrame, multi_line: bool = True,
                    large: int = LARGE_FILE) -> list[tuple[DataFrame, DataFrame]]:
    """Records and sources of the CSV files in a folder, one pair per distinct header.

    ``listed`` names all the files; those without any line have no header and
    are counted with the first group, as sources without records.
    """
    groups = headers(spark, path)
    if not groups:
        nothing = spark.createDataFrame(
            [], "source_id string, record_index bigint, units bigint, content struct<value: string>")
        return [(nothing, listed)]
    later = [(i,) for _, ids in groups[1:] for i in ids]
    pairs = []
    for k, (names, ids) in enumerate(groups):
        sources = spark.createDataFrame([(i,) for i in ids], "source_id string") if k else listed.select(
            "source_id").join(spark.createDataFrame(later, "source_id string"), "source_id", "left_anti")
        pairs.append((load_csv(spark, [plain_path(i) for i in ids], names, multi_line, large), sources))
    return pairs


def load_csv(spark: SparkSession, path: str | list[str], names: list[str] | None = None,
             multi_line: bool = True, large: int = LARGE_FILE) -> DataFrame:
    """Records of CSV files that share one header.

    All values are strings; missing and empty ones are ``""``; surplus values
    are dropped; of two equal header names the later one counts.  A file with
    another header makes the read fail; ``headers`` tells such files apart.
    Header names that differ only in case need ``spark.sql.caseSensitive``.

    A file of up to ``large`` bytes is read by one task.  A larger one is read
    in splits: its quotes are followed first, and where no quoted value holds a
    line end every line is a record; otherwise lines are put together
    (``split_records``).  ``multi_line=False`` says that no value holds a line
    end and saves looking.

    ``position`` orders the rows inside a file; ``index_records`` turns it into
    ``record_index`` once the rows are written somewhere.
    """
    paths = [path] if isinstance(path, str) else path
    if names is None:
        groups = headers(spark, paths)
        if len(groups) > 1:
            raise ValueError(f"files with different headers: {groups[0][1][0]} and {groups[1][1][0]}")
        names = groups[0][0] if groups else [""]
    if not multi_line:
        return _records(_read(spark, paths, names, False), names)
    sizes = spark.read.format("binaryFile").options(**_glob()).load(paths).filter(F.col("length") > large) \
        .select(F.col(FILE_PATH).alias("p"))
    to_split = sorted(r["p"] for r in sizes.collect())
    if not to_split:
        return _records(_read(spark, paths, names, True), names)
    starts = quote_states(_lines(spark, [plain_path(p) for p in to_split]))
    broken = sorted({source for source, _ in starts})
    plain = [p for p in to_split if p not in set(broken)]
    split = {bare_path(p) for p in to_split}
    rest = [p for p in spark.read.options(**_glob()).text(paths).inputFiles() if bare_path(p) not in split]
    parts = [_records(_read(spark, [plain_path(p) for p in own], names, multi), names)
             for own, multi in ((rest, True), (plain, False)) if own]
    if broken:
        parts.append(split_records(_lines(spark, [plain_path(p) for p in broken]), starts, names))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _columns(names: list[str]) -> list[str]:
    return [f"_c{i}" for i in range(len(names))]


def _schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in _columns(names)])


def _read(spark: SparkSession, paths: list[str], names: list[str], multi_line: bool) -> DataFrame:
    """The files' rows in columns ``_c0``, ``_c1`` and so on, and where they stand."""
    reader = spark.read.options(header=True, multiLine=multi_line, **_OPTIONS, **_glob())
    frame = reader.schema(_schema(names)).csv(paths).select(
        "*", F.col(FILE_PATH).alias("source_id"), F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")).alias("position"))
    return spread(frame, "position.seq") if multi_line else frame


def _records(frame: DataFrame, names: list[str]) -> DataFrame:
    last = {name: i for i, name in enumerate(names)}
    kept = [i for i, name in enumerate(names) if last[name] == i]
    order = {name: names.index(name) for name in last}
    kept.sort(key=lambda i: order[names[i]])
    columns = _columns(names)
    return frame.select(
        "source_id", F.lit(None).cast("bigint").alias("record_index"), F.lit(1).cast("bigint").alias("units"),
        F.struct(*[F.coalesce(F.col(identifier(columns[i])), F.lit("")).alias(names[i] or f"_c{i}") for i in kept]).alias("content"),
        "position")


# --- large files with line ends inside quoted values --------------------------


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col(FILE_PATH).alias("source_id"), F.col("_metadata.file_block_start").alias("block"), "value")


def quote_states(lines: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """For files in which some record spans lines: by file and split, whether it starts inside a quoted value, and the split
    in which the record that is open there began.

    Only lines with a quote can change the state, so only these reach Python.
    Every split is followed from both possible states at once; what it says is
    one row, and the driver, which plans one read per split, follows the states
    through each file.
    """
    def follow(batches):
        now, ends, closes, spans = None, [], [], []

        def row():
            return pa.RecordBatch.from_arrays([
                pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()),
                *[pa.array([x], pa.list_(pa.bool_())) for x in (ends, closes, spans)]], ["source_id", "block", "ends", "closes", "spans"])

        for batch in batches:
            for source, block, value in zip(*(batch.column(c).to_pylist() for c in ("source_id", "block", "value"))):
                if (source, block) != now:
                    if now is not None:
                        yield row()
                    now, ends, closes, spans = (source, block), [False, True], [True, False], [False, False]
                for k, inside in enumerate(ends):
                    ends[k] = still_open(value, inside)
                    closes[k] |= not ends[k]
                    spans[k] |= ends[k] or '"' not in value
        if now is not None:
            yield row()

    # Lines of blanks alone are records too, but only where lines are put together by hand.
    told = lines.filter(F.contains("value", F.lit('"')) | ((F.trim("value") == "") & (F.col("value") != "")))
    ship(lines.sparkSession)
    rows = told.mapInArrow(
        follow, "source_id string, block bigint, ends array<boolean>, closes array<boolean>, spans array<boolean>").collect()
    files: dict[str, list] = {}
    for r in rows:
        files.setdefault(r["source_id"], []).append((r["block"], r["ends"], r["closes"], r["spans"]))
    spanning: dict[str, list] = {}
    for source, splits in files.items():
        inside, any_span = False, False
        for _, ends, _, spans in sorted(splits):
            any_span |= spans[inside]
            inside = ends[inside]
        if any_span:
            spanning[source] = sorted(splits)
    if not spanning:
        return {}
    # The splits without a quote are listed only for files whose records span lines.
    every = lines.filter(F.col("source_id").isin(*spanning)) if len(spanning) < 1000 else lines
    blocks: dict[str, list[int]] = {}
    for r in every.select("source_id", "block").distinct().collect():
        if r["source_id"] in spanning:
            blocks.setdefault(r["source_id"], []).append(r["block"])
    starts = {}
    for source, splits in spanning.items():
        known = {block: rest for block, *rest in splits}
        inside, owner = False, 0
        for block in sorted(blocks[source]):
            starts[source, block] = (inside, owner)
            ends, closes, _ = known.get(block, ([False, True], [True, False], None))
            if closes[inside]:
                owner = block
            inside = ends[inside]
    return starts


def split_records(lines: DataFrame, starts: dict[tuple[str, int], tuple[bool, int]], names: list[str]) -> DataFrame:
    """Records of files whose values may hold line ends, every split by itself; only records that cross a border are shuffled."""
    shared = lines.sparkSession.sparkContext.broadcast(starts)
    found = ["source_id", "block", "seq", "part", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def follow(batches) -> Iterator[tuple]:
        """``(source, split of the record's first line, number in it, this split, text, whole)``."""
        now, held, inside, seq, head, first = None, [], False, 0, False, False

        def close(whole: bool):
            nonlocal held, seq, head, first
            text, held = "\n".join(held), []
            if first:  # the header
                first, head = False, False
                if header_names(text) != names:
                    raise ValueError(f"another header in {now[0]}")
            elif head:
                head = False
                yield now[0], owner, None, now[1], text, False
            elif text.strip("\r") or not whole:
                yield now[0], now[1], seq, now[1], text, whole
                seq += 1

        for batch in batches:
            for source, block, value in zip(*(batch.column(c).to_pylist() for c in ("source_id", "block", "value"))):
                if (source, block) != now:
                    if held:
                        yield from close(False)
                    now, seq = (source, block), 0
                    inside, owner = shared.value[now]
                    head, first = inside, block == 0
                if first and not held and not value.strip("﻿ \t\r"):
                    continue
                held.append(value)
                inside = still_open(value, inside) if '"' in value else inside
                if not inside:
                    yield from close(True)
        if held:
            yield from close(False)

    def run(whole: bool):
        def rows(batches):
            made = []
            for *row, complete in follow(batches):
                if complete == whole:
                    made.append(row)
                    if len(made) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], found)
                        made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], found)

        return rows

    columns = "source_id string, block bigint, seq bigint, part bigint, text string"
    crossing = lines.mapInArrow(run(False), columns).groupBy("source_id", "block").agg(
        F.max("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "part", "text"))), lambda p: p["text"]), "\n").alias("text"))
    texts = lines.mapInArrow(run(True), columns).select("source_id", "block", "seq", "text").unionByName(
        crossing.select("source_id", "block", "seq", "text"))
    parsed = F.from_csv("text", _schema(names).simpleString(), {**_OPTIONS, "maxCharsPerColumn": "-1"})
    return _records(texts.select("source_id", F.struct("block", "seq").alias("position"), parsed.alias("_r")).select(
        "source_id", "position", "_r.*"), names)
