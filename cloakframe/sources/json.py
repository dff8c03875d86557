"""JSON documents and JSON Lines as records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, in_scratch, ship
from .files import FILE_PATH, any_case, bare_path, plain_path, spread
from .json_blocks import large_documents

_BLANK = " \t\r\n"
# A file of more bytes is read by several tasks.
LARGE_FILE = 64 << 20
# Rows and characters of an output batch.
BATCH_ROWS, BATCH_CHARS = 10_000, 4 << 20
_RECORDS = "source_id string, record_index bigint, units bigint, content string"
_POSITION = "struct<block:bigint,seq:bigint>"


def _values(text: str) -> list:
    """The document as one JSON value, or as one value per line; anything else raises.

    Whatever follows the first value is either read or an error.  Of repeated
    keys the last counts.
    """
    text = text.removeprefix("\ufeff")
    try:
        return [json.loads(text)]
    except json.JSONDecodeError as whole:
        lines = [line for line in text.split("\n") if line.strip(_BLANK)]
        if len(lines) < 2:
            raise
        try:
            return [[json.loads(line) for line in lines]]
        except json.JSONDecodeError:
            raise whole from None


def _plain(value: object) -> object:
    """The value with the numbers JSON cannot write, NaN and the infinities, as their names."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return json.dumps(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def json_text(value: object) -> str:
    """The value as JSON text, without what tables cannot hold (see ``normalize_json``)."""
    try:
        text = json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except ValueError:
        text = json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"))
    try:
        text.encode()
    except UnicodeEncodeError:  # half a character, which no text may hold
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def _record(value: object) -> str:
    return json_text(value if isinstance(value, dict) else {"value": value})


def _item(text: bytes) -> str:
    return _record(json.loads(text))


def _records(text: str) -> Iterator[tuple[int | None, int, str]]:
    for value in _values(text):
        if isinstance(value, dict) and isinstance(value.get("records"), list):
            value = value["records"]
        if isinstance(value, list):
            for i, item in enumerate(value):
                yield i, 1, _record(item)
        else:
            yield None, len(value) if isinstance(value, dict) else 1, _record(value)


def normalize_json(documents: DataFrame, source_id: Column, text: Column) -> DataFrame:
    """Records of JSON documents, each still a JSON object in ``content``.

    A list gives one record per item, and JSON Lines one per line; a
    ``records`` list inside an object is taken for the object; any other object
    is one document (no index, its record count is its number of keys); what is
    not an object is wrapped as ``{"value": …}``.  A document is parsed as a
    whole by one task; a null document gives no record.  ``NaN`` and the
    infinities become texts of that name, half of a surrogate pair the
    replacement character.
    """
    names = ["source_id", "record_index", "units", "content"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def parse(batches):
        held: list[tuple] = []
        chars = 0
        for batch in batches:
            for source, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in () if document is None else _records(document):
                    held.append((source, *row))
                    chars += len(row[2])
                    if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    ship(documents.sparkSession)
    return documents.select(source_id.cast("string").alias("source_id"), text.alias("text")).mapInArrow(parse, _RECORDS)


def json_lines(lines: DataFrame, source_id: Column, text: Column) -> DataFrame:
    """Records of JSON Lines read line by line, so large files are read in splits.

    ``position`` orders the rows inside a file; ``index_records`` turns it into
    ``record_index`` once the rows are written somewhere.
    """
    def parse(batches):
        for batch in batches:
            values = [json.loads(t.removeprefix("\ufeff")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("source_id"), pa.array([_record(v) for v in values], pa.string()), batch.column("block"),
                 batch.column("seq")], ["source_id", "content", "block", "seq"])

    ship(lines.sparkSession)
    filled = lines.filter(F.trim(F.regexp_replace(text, "[\\t\\r\ufeff]", "")) != "")
    kept = filled.select(
        source_id.cast("string").alias("source_id"), text.alias("text"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"))
    return kept.mapInArrow(parse, "source_id string, content string, block bigint, seq bigint").select(
        "source_id", F.lit(None).cast("bigint").alias("record_index"), F.lit(1).cast("bigint").alias("units"), "content",
        F.struct("block", "seq").alias("position"))


# Type names of the merged variant schema that the struct schema spells differently.
_TYPE_NAME = re.compile(r"`(?:[^`]|``)*`|\b(?:OBJECT(?=<)|VARIANT|VOID|DECIMAL\(\d+,\s*\d+\))(?!\s*:)")


def _struct_type(merged: str) -> str:
    def spell(m: re.Match[str]) -> str:
        name = m.group(0)
        if name.startswith("`"):
            return name
        if name == "OBJECT":
            return "STRUCT"
        return "DOUBLE" if name.startswith("DECIMAL") else "STRING"

    return _TYPE_NAME.sub(spell, merged)


def json_schema(records: DataFrame) -> str:
    """Schema that fits every record; where records disagree the field is a STRING.

    The types are merged on the executors; the driver sees one type string.
    """
    merged = records.agg(F.schema_of_variant_agg(F.parse_json("content")).alias("s")).first()["s"]
    return _struct_type(merged) if merged and merged.startswith("OBJECT") else "STRUCT<value: STRING>"


def typed_records(records: DataFrame, schema: str | None = None) -> DataFrame:
    """Turn JSON-object records into struct records; pass ``schema`` to save a pass.

    Inside a job the parsed records are written once, for the schema and for what follows.
    """
    if schema is None and in_scratch():
        records = cut(records, "json-records")
    return records.withColumn("content", F.from_json("content", schema or json_schema(records)))


def variant_records(records: DataFrame) -> DataFrame:
    """Turn JSON-object records into VARIANT records, for listings without a common schema."""
    return records.withColumn("content", F.parse_json("content"))


def load_json_text(spark: SparkSession, path: str, lines: bool = False, large: int = LARGE_FILE) -> DataFrame:
    """Records of JSON files, each still a JSON object in ``content``; see ``load_json``."""
    ship(spark)
    reader = spark.read.option("pathGlobFilter", any_case("json"))

    def by_line(paths: str | list[str]) -> DataFrame:
        return json_lines(reader.text(paths), F.col(FILE_PATH), F.col("value"))

    def whole(paths: str | list[str]) -> DataFrame:
        texts = spread(reader.text(paths, wholetext=True).select(F.col(FILE_PATH).alias("p"), "value"))
        return normalize_json(texts, F.col("p"), F.col("value"))

    if lines:
        return by_line(path)
    # Only names and sizes are read, and only large files come back.
    sizes = reader.format("binaryFile").load(path).filter(F.col("length") > large).select(F.col(FILE_PATH).alias("p"))
    to_split = {r["p"] for r in sizes.collect()}
    if not to_split:
        return whole(path)
    split, line_files, one_value = large_documents(spark, [plain_path(p) for p in sorted(to_split)], _item)
    listed = reader.text(path).inputFiles()
    known = {bare_path(p) for p in to_split} - {bare_path(p) for p in one_value}
    rest = [plain_path(p) for p in listed if bare_path(p) not in known]
    parts = [p for p in (split, whole(rest) if rest else None) if p is not None]
    if line_files:
        parts = [p.withColumn("position", F.lit(None).cast(_POSITION)) for p in parts]
        parts.append(by_line([plain_path(p) for p in line_files]))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def load_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False,
              large: int = LARGE_FILE) -> DataFrame:
    """Records of JSON files.

    Every file is one document, or one value per line.  A file of more than
    ``large`` bytes is read by several tasks, whatever its line breaks: a
    list item by item, JSON Lines line by line; only an object without a
    ``records`` list, which is one record, stays whole.  Pass ``lines=True``
    for files known to be JSON Lines; pass ``schema`` to save the pass that
    finds the common one.
    """
    return typed_records(load_json_text(spark, path, lines, large), schema)
