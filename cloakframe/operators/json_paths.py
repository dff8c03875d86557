"""Records kept as JSON texts: values are found and rewritten at their own paths.

A struct gives all records one schema, so a field with several types becomes
text, keys are put in one order and a missing key becomes a null.  Here every
record stays the JSON object it is (``sources.json.load_json_text``): its
scalars are listed as cells, the rules search the cells as SQL expressions, and
a record with hits is opened once more to put the new values in.  Both steps are
narrow; records without hits are not touched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import name_fits
from ..shared import ship
from ..sources.json import json_text
from .cells import is_text
from .detect import Detector, ExternalDetector

_CELL_TYPE = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("name_bits", T.IntegerType())])
_CELLS = pa.list_(pa.struct([("path", pa.string()), ("name", pa.string()), ("text", pa.string()), ("name_bits", pa.int32())]))


# Records turned into Python values at a time, and bytes of their texts.
SLICE_ROWS, SLICE_BYTES = 1_000, 4 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where to cut a batch, and how many rows to take, so that it never is Python values as a whole."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(texts):
        fits = int(np.searchsorted(np.cumsum(sizes[start:start + SLICE_ROWS], dtype=np.int64), SLICE_BYTES))
        yield start, max(1, fits)
        start += max(1, fits)


def scalars(record: object) -> Iterator[tuple[dict | list, str | int, str]]:
    """``(container, key, printed path)`` of every scalar of a record, depth first, in the order of the text.

    A container may be changed at the key just given, as long as it keeps its keys.
    """
    waiting: list[tuple] = [(None, None, None, record)]
    while waiting:
        holder, key, path, value = waiting.pop()
        if isinstance(value, dict):
            waiting += [(value, k, k if path is None else f"{path}.{k}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            waiting += [(value, i, f"{path or ''}[{i}]", value[i]) for i in range(len(value) - 1, -1, -1)]
        elif holder is not None:
            yield holder, key, path


def is_json_text(records: DataFrame, input_format: str | None) -> bool:
    """Whether the records of a format are JSON texts; other JSON records are structs."""
    return input_format == "json" and is_text(records.schema["content"].dataType)


@lru_cache(10_000)
def _name_bits(hints: tuple[tuple[str, ...], ...], name: str) -> int:
    return sum(1 << k for k, own in enumerate(hints) if name_fits(own, name))


def _with_cells(records: DataFrame, hints: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Add ``_cells``, the scalars of the JSON objects; ``hints`` are those of the field-name rules, a bit each."""
    names = [*records.columns, "_cells"]

    def cells(text: str | None) -> list[dict]:
        made = []
        for holder, key, path in scalars(None if text is None else json.loads(text)):
            value, name = holder[key], key if isinstance(key, str) else None
            made.append({"path": path, "name": name, "text": None if value is None else str(value),
                         "name_bits": 0 if name is None else _name_bits(hints, name)})
        return made

    def run(batches):
        for batch in batches:
            for start, n in _slices(batch.column("content")):
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(cells, part.column("content").to_pylist()), _CELLS)], names)

    schema = T.StructType([*records.schema.fields, T.StructField("_cells", T.ArrayType(_CELL_TYPE))])
    return records.mapInArrow(run, schema)


def annotate_json(records: DataFrame, detector: Detector | ExternalDetector | None = None) -> DataFrame:
    """Add ``hits`` to records whose ``content`` is a JSON object as text.

    ``field_ordinal`` counts the scalars of the record in the order of its
    text, nulls included.  A null content has no hits.  An external analyzer
    sees the JSON text itself.
    """
    detector = detector or Detector()
    if isinstance(detector, ExternalDetector):
        return detector.annotate(records)
    ship(records.sparkSession)
    listed = _with_cells(records, tuple(tuple(r.hints) for r in detector.context))
    return listed.withColumn("hits", F.expr(detector.cell_hits("_cells"))).drop("_cells")


def _rewritten(text: str, changes: list[dict]) -> str:
    record = json.loads(text)
    at: dict[tuple[int, str], list[dict]] = {}
    for change in changes:
        at.setdefault((change["field_ordinal"], change["field_path"]), []).append(change)
    changed = False
    for ordinal, (holder, key, path) in enumerate(scalars(record)):
        for change in at.get((ordinal, path), ()):
            changed = True
            old = holder[key]
            holder[key] = old.replace(change["value"], change["sanitized"]) if isinstance(old, str) else change["sanitized"]
    return json_text(record) if changed else text


def write_back_json(protected: DataFrame) -> DataFrame:
    """Replace ``content``, a JSON object as text, by its sanitized form.

    Texts are replaced hit by hit in detection order; a number or boolean that
    a rule matches becomes the first hit's replacement.  All other values keep
    their type, and keys their order.  ``hits`` must carry ``sanitized``; hits
    that sit at no scalar of the record (those of an external analyzer) change
    nothing.
    """
    ship(protected.sparkSession)
    names = protected.columns

    def run(batches):
        for batch in batches:
            for start, n in _slices(batch.column("content")):
                part = batch.slice(start, n)
                done = [_rewritten(t, hits) if t and hits else t
                        for t, hits in zip(part.column("content").to_pylist(), part.column("hits").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done, pa.string()) if c == "content" else part.column(c) for c in names], names)

    return protected.mapInArrow(run, protected.schema)
