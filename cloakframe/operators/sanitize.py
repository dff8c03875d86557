"""Rewriting records: every hit's value is replaced at its own field path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.protect import REPLACE_IN_ORDER, REPLACE_WHOLE, protect_value
from ..functions.text import FieldPath, cell_text
from ..rules import check_mode
from .cells import is_text, rewrite
from .detect import Detector, unfold


def protect_hits(annotated: DataFrame, mode: str) -> DataFrame:
    """Add ``sanitized`` to every hit (modes ``mask`` and ``redact``); narrow."""
    check_mode(mode)
    return annotated.withColumn("hits", F.transform("hits", lambda h: h.withField(
        "sanitized", protect_value(mode, h["value"], h["entity_type"]))))


def write_back(protected: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Replace ``content`` by its sanitized form.

    Hits of one field are applied in detection order.  A number, date or
    boolean that a rule can match becomes a STRING field, because its
    replacement is text; fields no rule can match keep their type.  The column
    ``hits`` must carry ``sanitized``.
    """
    detector = detector or Detector()

    def change(value: str, leaf: T.DataType, path: FieldPath, ordinal: int) -> str | None:
        if detector.candidate_text(value, leaf) is None:
            return None
        # Printed paths of different fields can be equal; the field's ordinal tells them apart.
        own = f"h.field_ordinal = {ordinal} AND h.field_path = {path.sql()}"
        mine = f"filter(hits, h -> {own})"
        if is_text(leaf):
            return f"CASE WHEN size(hits) = 0 THEN {value} ELSE {REPLACE_IN_ORDER.format(hits=mine, text=value)} END"
        as_text = cell_text(value, leaf)
        return (f"CASE WHEN exists(hits, h -> {own}) "
                f"THEN {REPLACE_WHOLE.format(hits=mine)} ELSE {as_text} END")

    return protected.withColumn("content", F.expr(
        rewrite("content", protected.schema["content"].dataType, change)))


def transformations(protected: DataFrame, mode: str) -> DataFrame:
    """One row per applied replacement, whether or not it still found its value."""
    return unfold(protected, "source_id", "record_index", F.lit(check_mode(mode)).alias("mode"))
