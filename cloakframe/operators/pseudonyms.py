"""Stable pseudonyms: one number per entity type and exact value, kept in a table.

A value already in the table keeps its pseudonym.  New values get the next
numbers of their type in first-seen order, as ``TYPE_001``, ``TYPE_002``, …
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import BROADCAST_BYTES, BROADCAST_ROWS, cut
from .detect import Detector, detection_order, detections
from .records import index_records

MAP_SCHEMA = "entity_type string, value string, pseudonym_no bigint, pseudonym string"
KEYS = ["entity_type", "value"]
_ORDER = ["source", "rank", "record", "field", "item", "rule", "start"]
# A value with more than this share of all hits is joined by broadcast.
HOT_SHARE = 1_000


def pseudonym_text(entity_type: Column, number: Column) -> Column:
    """``TYPE_%03d``; numbers above 999 simply grow longer."""
    return F.format_string("%s_%03d", entity_type, number)


class Conflict(Exception):
    """Another run added a version first."""


class PseudonymStore:
    """The pseudonym table on disk, for any number of runs that read and add at once.

    Entries lie in data folders, parted by a hash of type and value, and a run
    reads only the parts its values fall into.  What belongs to the table says
    a log of numbered files, each with its data folder and the last number of
    every type.  A run writes its data folder first and then claims the next
    number by renaming a file to it, which fails if that number is there.  The
    run that comes second looks again at the values that appeared and numbers
    only the others.  A folder no log file names is not part of the table, so a
    run may end at any point.  The file system's rename must refuse an existing
    target, as HDFS does.
    """

    # Parts of the table; more make small runs read less and large tables write more files.
    BUCKETS = 64
    # Data folders in use before they are written together.
    FOLDERS = 32

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the log, oldest first."""
        log = self._path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n) for n in names if n.isdigit())

    def _log(self) -> list[dict]:
        """Entries of the log, oldest first; from the last compaction on."""
        numbers = self.versions()
        if not numbers:
            return []
        schema = "version bigint, folder string, whole boolean, counters map<string,bigint>"
        rows = self.spark.read.schema(schema).json([f"{self.path}/_log/{n}" for n in numbers]).collect()  # one row per version
        entries = sorted((r.asDict() for r in rows), key=lambda e: e["version"])
        last = max((i for i, e in enumerate(entries) if e["whole"]), default=0)
        return entries[last:]

    def _read(self, log: list[dict]) -> DataFrame:
        if not log:
            return self.spark.createDataFrame([], f"{MAP_SCHEMA}, bucket int")
        frames = [self.spark.read.schema(f"{MAP_SCHEMA}, bucket int").parquet(f"{self.path}/{e['folder']}") for e in log]
        found = frames[0]
        for frame in frames[1:]:
            found = found.unionByName(frame)
        return found

    def load(self) -> DataFrame:
        """All entries; an empty table when there are none yet."""
        return self._read(self._log()).drop("bucket")

    @classmethod
    def bucket(cls) -> Column:
        return F.pmod(F.xxhash64(*KEYS), F.lit(cls.BUCKETS)).cast("int")

    def import_json(self, path: str) -> None:
        """Take over a map kept as one JSON document with ``values: {"TYPE::value": pseudonym}``."""
        text = self.spark.read.text(path, wholetext=True)
        entries = text.select(F.explode(F.from_json("value", "values map<string,string>")["values"]).alias("k", "pseudonym"))
        cut_at = F.instr("k", "::")
        self.save(entries.select(
            F.substring("k", F.lit(1), cut_at - 1).alias("entity_type"),
            F.substring("k", cut_at + 2, F.length("k")).alias("value"),
            F.regexp_extract("pseudonym", "_([0-9]+)$", 1).cast("bigint").alias("pseudonym_no"), "pseudonym"))

    def save(self, new: DataFrame) -> None:
        """Add entries with numbers of their own; raises ``Conflict`` if another run adds some meanwhile."""
        log = self._log()
        self._add(new, log[-1]["version"] if log else 0, log[-1]["counters"] if log else {})

    def _write(self, entries: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        # One file per part: a run's entries are few beside the table.
        entries.select("entity_type", "value", "pseudonym_no", "pseudonym", self.bucket().alias("bucket")) \
            .repartition("bucket").sortWithinPartitions("bucket", *KEYS) \
            .write.option("parquet.bloom.filter.enabled#value", "true").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _claim(self, version: int, folder: str, whole: bool, counters: dict[str, int]) -> None:
        entry = json.dumps({"version": version, "folder": folder, "whole": whole, "counters": counters})
        made = self._path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(entry.encode())
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(made), self._fs.makeQualified(self._path(f"{self.path}/_log/{version}")), options)
        except Py4JJavaError as error:
            self._fs.delete(made, False)
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            if "AlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {version} of {self.path} exists") from None
            raise

    def _add(self, new: DataFrame, known_version: int, counters: dict[str, int]) -> None:
        folder = self._write(new)
        written = self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/{folder}")
        highest = {r["entity_type"]: r["n"] for r in written.groupBy("entity_type").agg(F.max("pseudonym_no").alias("n")).collect()}
        self._claim(known_version + 1, folder, False, counters | {t: max(n, counters.get(t, 0)) for t, n in highest.items()})

    def name(self, values: DataFrame) -> DataFrame:
        """Pseudonyms of all ``values`` (see ``first_seen``), after those that are new were added to the table."""
        parts = [r["b"] for r in values.select(self.bucket().alias("b")).distinct().collect()]  # BUCKETS rows at most
        while True:
            log = self._log()
            known = self._read(log).filter(F.col("bucket").isin(parts)).drop("bucket")
            counters = log[-1]["counters"] if log else {}
            lookup, new = assign_values(values, known, counters)
            if not new.limit(1).count():
                break
            try:
                self._add(new, log[-1]["version"] if log else 0, counters)
                break
            except Conflict:
                continue
        if len(log) >= self.FOLDERS:
            self.compact()
        return lookup

    def compact(self) -> None:
        """Write all data folders together; if another run adds a version meanwhile, the table stays as it is.

        Older folders stay for runs that read them; ``vacuum`` removes them.
        """
        log = self._log()
        if len(log) > 1:
            with contextlib.suppress(Conflict):
                self._claim(log[-1]["version"] + 1, self._write(self._read(log)), True, log[-1]["counters"])

    def vacuum(self) -> None:
        """Remove data folders the table no longer uses.  Only while no other run reads or adds."""
        used = {e["folder"] for e in self._log()}
        for status in self._fs.listStatus(self._path(self.path)) if used else ():
            name = status.getPath().getName()
            if name.startswith("data-") and name not in used:
                self._fs.delete(status.getPath(), True)


def first_seen(found: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Distinct ``(entity_type, value)`` with its earliest position and number of hits.

    Partial aggregation runs before the shuffle, so a value repeated millions
    of times arrives once per task.
    """
    order = F.struct(*[c.alias(n) for c, n in zip(detection_order(detector), _ORDER)])
    return found.groupBy(*KEYS).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def number_new(new: DataFrame, counters: Mapping[str, int]) -> DataFrame:
    """Give new values the next numbers of their type in ``first`` order; ``counters`` has the last one given of each type.

    One window per type would put a type with most of the values into one task.
    Instead the values are range-partitioned by type and position, each
    partition numbers its own rows, and a small table of offsets (one row per
    type and partition) makes the numbers consecutive.  The partitions are
    written once, so counting and numbering see the same ones.
    """
    # Rows without a key share their position; the value then decides, so a rerun gives the same numbers.
    order = ["entity_type", *[f"first.{n}" for n in _ORDER], "value"]
    ranged = cut(
        new.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id()), "ranged"
    ).withColumn("_part", F.shiftright("_row", 33))
    used = new.sparkSession.createDataFrame(list(counters.items()), "entity_type string, _used bigint")
    before = Window.partitionBy("entity_type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("entity_type", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(F.broadcast(used), "entity_type", "left")
        .select("entity_type", "_part", (
            F.col("_before") + F.coalesce("_used", F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    # At most (entity types x shuffle partitions) rows, whatever the data.
    numbered = ranged.join(F.broadcast(offsets), ["entity_type", "_part"]) \
        .withColumn("pseudonym_no", F.col("_row") + F.col("_shift"))
    return numbered.select(*KEYS, "pseudonym_no", pseudonym_text(
        F.col("entity_type"), F.col("pseudonym_no")).alias("pseudonym"), "n")


def assign_values(values: DataFrame, known: DataFrame, counters: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """``(lookup, new)``: pseudonyms of all ``values``, a written table, and the entries to add to the table."""
    # The table may be far larger than one run's values: cut it down to them first.  The planner
    # knows the size of the written values and broadcasts them when they are few.
    met = cut(known.join(values.select(*KEYS), KEYS, "left_semi"), "known-values")
    new = cut(number_new(values.join(met, KEYS, "left_anti"), counters), "new-values")
    old = values.join(met, KEYS).select(*KEYS, "pseudonym_no", "pseudonym", "n")
    return old.unionByName(new), new.drop("n")


def assign(found: DataFrame, known: DataFrame, detector: Detector | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lookup, new)``: pseudonyms of all values in ``found``, and the entries to add to the table ``known``."""
    used = known.groupBy("entity_type").agg(F.max("pseudonym_no").alias("n")).collect()
    return assign_values(cut(first_seen(found, detector), "values"), known, {r["entity_type"]: r["n"] for r in used})


def with_pseudonyms(hits: DataFrame, lookup: DataFrame) -> DataFrame:
    """Join hits with the pseudonyms of their values.

    A small lookup table is broadcast.  Otherwise the few values that hold more
    than 1/1000 of all hits each (so at most 1000 of them) are joined by
    broadcast and only the remaining, rarer ones are shuffled.
    """
    size = lookup.agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("value") + 64).alias("bytes"), F.sum("n").alias("hits"),
    ).first()
    names = lookup.select(*KEYS, "pseudonym")
    if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return hits.join(F.broadcast(names), KEYS)
    # Values are cut out of texts and can be long; a hot one that is stays on the shuffle side.
    is_hot = F.col("n") * HOT_SHARE > size["hits"]
    is_short = F.octet_length("value") <= BROADCAST_BYTES // HOT_SHARE
    hot = lookup.filter(is_hot & is_short).select(*KEYS, "pseudonym")
    # Everything else is shuffled, on as many salts as its hits need.
    share = max(1, size["hits"] // HOT_SHARE)
    rest = lookup.filter(~(is_hot & is_short)).select(*KEYS, "pseudonym", F.explode(
        F.sequence(F.lit(0), F.floor(F.col("n") / share).cast("int"))).alias("_salt"), F.floor(F.col("n") / share).cast("int").alias("_last"))
    # At most HOT_SHARE digests of long values are broadcast to say how many salts a value has.
    digest = F.sha2(F.concat_ws(":", *KEYS), 256)
    many = rest.filter("_last > 0 and _salt = 0").select(digest.alias("_k"), "_last")
    left = hits.join(F.broadcast(hot.select(*KEYS)), KEYS, "left_anti").withColumn("_k", digest) \
        .join(F.broadcast(many), "_k", "left") \
        .withColumn("_salt", F.pmod(F.xxhash64("_id", "_pos"), F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_k", "_last")
    return hits.join(F.broadcast(hot), KEYS).unionByName(left.join(rest.drop("_last"), [*KEYS, "_salt"]).drop("_salt"))


def _placed(annotated: DataFrame) -> DataFrame:
    """The annotated records, written once, so the source is read and searched once and all that follows sees the same rows.

    Rows of files get their place in the file first, because numbers follow it.
    """
    return index_records(cut(annotated.withColumn("_id", F.monotonically_increasing_id()), "annotated"))


def _named(held: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add ``sanitized`` to every hit; only records with hits are shuffled."""
    hit_rows = held.filter(F.size("hits") > 0)
    values = hit_rows.select("_id", F.posexplode("hits").alias("_pos", "_hit")).select(
        "_id", "_pos", F.col("_hit.entity_type").alias("entity_type"), F.col("_hit.value").alias("value"))
    names = (
        with_pseudonyms(values, lookup)
        .groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "pseudonym"))).alias("_names"))
    )
    protected = hit_rows.join(names, "_id").withColumn("hits", F.zip_with(
        "hits", "_names", lambda h, n: h.withField("sanitized", n["pseudonym"]))).drop("_id", "_names")
    untouched = held.filter(F.size("hits") == 0).drop("_id").withColumn(
        "hits", F.array().cast(protected.schema["hits"].dataType))
    return untouched.unionByName(protected)


def pseudonymize_hits(annotated: DataFrame, known: DataFrame,
                      detector: Detector | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``sanitized`` to every hit from the pseudonym table ``known``; returns the records and the new entries."""
    held = _placed(annotated)
    lookup, new = assign(detections(held.filter(F.size("hits") > 0)), known, detector)
    return _named(held, lookup), new


def pseudonymize_with(annotated: DataFrame, store: PseudonymStore, detector: Detector | None = None) -> DataFrame:
    """Add ``sanitized`` to every hit; new pseudonyms are in the store before any is used, also while other runs add some."""
    held = _placed(annotated)
    values = cut(first_seen(detections(held.filter(F.size("hits") > 0)), detector), "values")
    return _named(held, store.name(values))
