"""Finding personal data: records in, hits out.

``annotate`` adds one array column of hits to every record.  All rules are
evaluated in the same projection, so a table is scanned once and nothing is
shuffled.  ``detections`` unfolds the array into a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as R
from ..functions.matching import HIT_TYPE, NO_HITS, Place, context_hits, joined, single_hit, text_hits
from ..functions.text import ROOT_PATH, FieldPath, cell_text, name_fits, name_fits_sql
from ..shared import join_many_to_one
from .cells import cells, is_leaf, is_text, record_text, static_leaves

# Up to this many plain leaves get their own compiled expression; those of a
# wider record are walked as an array of cells, which keeps the plan small.
# Hits and their ordinals are the same either way.
INLINE_LEAVES = 40

_FULL_INT_TYPES = (T.IntegerType, T.LongType)
_FRACTION_TYPES = (T.FloatType, T.DoubleType)
_TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


class Detector:
    """The rules of one run and what they can possibly match by column type."""

    def __init__(self, spark=None, custom: Mapping[str, object] | None = None,
                 entities: Iterable[str] | None = None):
        entities = None if entities is None else tuple(entities)
        self.custom = R.select_rules(R.custom_rules(spark, custom), entities)
        self.rules = R.select_rules(R.DEFAULT_RULES, entities) + self.custom
        self.context = R.select_rules(R.CONTEXT_RULES, entities)
        self.types = {r.entity_type for r in self.rules}

    def candidate_text(self, value: str, dtype: T.DataType) -> str | None:
        """SQL text of a leaf where some rule can match, null or None where none can.

        Default rules see in a number at most a run of 8 to 12 digits, in a
        date or time at most a date or a fraction, in a boolean nothing.  A
        custom rule may match anything, so it switches this pruning off.
        """
        if isinstance(dtype, (T.BinaryType, T.NullType)):
            return None
        if is_text(dtype) or self.custom:
            return cell_text(value, dtype)
        if isinstance(dtype, _TIME_TYPES):
            return cell_text(value, dtype) if self.types & {"BIRTH_DATE", "PHONE"} else None
        if "PHONE" not in self.types:
            return None
        if isinstance(dtype, _FULL_INT_TYPES):
            return f"CASE WHEN {_phone_sized(value)} THEN cast({value} as string) END"
        if isinstance(dtype, T.DecimalType) and dtype.precision >= 8:
            return cell_text(value, dtype)
        if isinstance(dtype, _FRACTION_TYPES):
            return cell_text(value, dtype)
        return None

    def _typed_hits(self, value: str, dtype: T.DataType, place: Place) -> str | None:
        """Hits in an integer, date or timestamp, decided on the value itself.

        The text of such a value has one fixed shape.  An integer is a phone
        number when it has 8 to 12 digits; a date of the years 1900 to 2099 is a
        date hit; the seconds of a timestamp with a fraction (``SS.ffffff``) have
        the shape of a phone number.  None for other types.
        """
        if self.custom:
            return None
        ranked = {r.entity_type: (r, k) for k, r in enumerate(self.rules)}
        phone, date = ranked.get("PHONE"), ranked.get("BIRTH_DATE")
        text = f"cast({value} as string)"
        if isinstance(dtype, _FULL_INT_TYPES):
            return phone and single_hit(
                _phone_sized(value), *phone, place, f"ltrim('-', {text})",
                f"if({value} < 0, 1, 0)", f"length({text})")
        if not isinstance(dtype, _TIME_TYPES):
            return None
        parts = []
        if phone and not isinstance(dtype, T.DateType):
            parts.append(single_hit(f"contains({text}, '.')", *phone, place,
                                    f"rpad(substring({text}, 18, 9), 9, '0')", "17", "26"))
        if date:
            parts.append(single_hit(f"year({value}) BETWEEN 1900 AND 2099", *date, place,
                                    f"left({text}, 10)", "0", "10"))
        return joined(parts)

    def _leaf_hits(self, text: str, dtype: T.DataType, name: str | None, place: Place) -> str:
        """Hits in a leaf whose type and name are known on the driver."""
        usable = None if is_text(dtype) or self.custom else {"PHONE"}
        found = [text_hits(text, self.rules, place, usable)]
        fitting = [(len(self.rules) + k, r, "true") for k, r in enumerate(self.context)
                   if is_text(dtype) and name is not None and name_fits(r.hints, name)]
        if fitting:
            found.append(context_hits(text, fitting, place))
        return joined(found)

    def _name_bits(self, name: str | None, key: str | None) -> str:
        if name is not None:
            return str(sum(1 << k for k, r in enumerate(self.context) if name_fits(r.hints, name)))
        if key is None or not self.context:
            return "0"
        return " + ".join(f"if({name_fits_sql(r.hints, key)}, {1 << k}, 0)" for k, r in enumerate(self.context))

    def _walked(self, value: str, dtype: T.DataType, ordinal: int | None,
                path: FieldPath = FieldPath(), name: str | None = None) -> str | None:
        """Hits of a list, a map or a wide record, found by walking its cells."""
        found = cells(value, dtype, self.candidate_text, path, name, None, self._name_bits)
        if found is None:
            return None
        return self.cell_hits(found, Place("ci", "0", "c.path") if ordinal is None else Place(str(ordinal), "ci", "c.path"))

    def cell_hits(self, found: str, place: Place = Place("ci", "0", "c.path")) -> str:
        """Hits (SQL) of an array of cells ``c`` at the places ``ci``."""
        fitting = [(len(self.rules) + k, r, f"(c.name_bits & {1 << k}) > 0") for k, r in enumerate(self.context)]
        hits = joined([text_hits("c.text", self.rules, place), context_hits("c.text", fitting, place)])
        return f"coalesce(flatten(transform({found}, (c, ci) -> {hits})), {NO_HITS})"

    def _wide(self, leaves: list) -> str | None:
        """Hits of the plain leaves of a wide record, walked as one array of cells with their ordinals."""
        made = []
        for ordinal, (value, leaf, path, name) in leaves:
            text = self.candidate_text(value, leaf)
            if text is not None:
                bits = self._name_bits(name, None) if is_text(leaf) else "0"
                made.append(f"named_struct('ordinal', {ordinal}, 'path', {path.sql()}, 'text', {text}, 'name_bits', {bits}, "
                            f"'any_rule', {str(is_text(leaf) or isinstance(leaf, _TIME_TYPES) or bool(self.custom)).lower()})")
        if not made:
            return None
        place = Place("c.ordinal", "0", "c.path")
        fitting = [(len(self.rules) + k, r, f"(c.name_bits & {1 << k}) > 0") for k, r in enumerate(self.context)]
        numbers = text_hits("c.text", self.rules, place, {"PHONE"})
        hits = joined([f"CASE WHEN c.any_rule THEN {text_hits('c.text', self.rules, place)} ELSE {numbers} END",
                       context_hits("c.text", fitting, place)])
        return f"coalesce(flatten(transform(array({', '.join(made)}), c -> {hits})), {NO_HITS})"

    def hits(self, dtype: T.DataType, content: str = "content") -> tuple[dict[str, str], str]:
        """Hits of a record or text, ``array<struct<field_ordinal, item_ordinal, field_path, …>>``.

        Returns SQL text in two steps: columns with the texts of non-text
        leaves, so that each is formatted once, and the array built on them.
        """
        texts: dict[str, str] = {}
        leaves = list(static_leaves(content, dtype))
        numbered = list(enumerate(leaves))
        parts = []
        if len(leaves) > INLINE_LEAVES:
            plain = [(k, leaf) for k, leaf in numbered if not isinstance(leaf[1], (T.ArrayType, T.MapType)) and is_leaf(leaf[1])]
            wide = self._wide(plain)
            parts += [wide] if wide else []
            numbered = [(k, leaf) for k, leaf in numbered if isinstance(leaf[1], (T.ArrayType, T.MapType))]
        for ordinal, (value, leaf_type, path, name) in numbered:
            if isinstance(leaf_type, (T.ArrayType, T.MapType)):
                part = self._walked(value, leaf_type, ordinal, path, name)
            else:
                is_leaf(leaf_type)
                part, place = None, Place(str(ordinal), "0", path.sql())
                text = self.candidate_text(value, leaf_type)
                if text is not None:
                    part = self._typed_hits(value, leaf_type, place)
                    if part is None:
                        if text != value:
                            texts[f"_text_{ordinal}"] = text
                            text = f"_text_{ordinal}"
                        part = self._leaf_hits(text, leaf_type, name, place)
            if part is not None:
                parts.append(part)
        return texts, joined(parts)

    def annotate(self, records: DataFrame) -> DataFrame:
        texts, hits = self.hits(records.schema["content"].dataType)
        staged = records.withColumns({name: F.expr(text) for name, text in texts.items()}) if texts else records
        return staged.withColumn("hits", F.expr(hits)).drop(*texts)


def _phone_sized(value: str) -> str:
    return f"({value} BETWEEN 10000000 AND 999999999999 OR {value} BETWEEN -999999999999 AND -10000000)"


def annotate(records: DataFrame, detector: Detector | ExternalDetector | None = None) -> DataFrame:
    """Add ``hits`` to every record: one scan, all rules, no shuffle."""
    return (detector or Detector()).annotate(records)


def unfold(annotated: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per hit, with the ``keep`` columns of its record.

    The outer form matters: for a plain ``inline`` the optimizer adds a filter
    on the size of the array and pushes it below the projection that computes
    the array, so every rule would run again for it.
    """
    return annotated.select(*keep, F.inline_outer("hits")).filter(F.col("entity_type").isNotNull())


def detections(annotated: DataFrame, keep: Iterable[str] = ("source_id", "record_index")) -> DataFrame:
    """One row per hit: where it is, what it is, and which rule found it."""
    return unfold(annotated, *keep)


def detect(records: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Records in, one row per hit out."""
    return detections(annotate(records, detector))


def detection_order(detector: Detector | None = None) -> list[Column]:
    """Sort key of a listing: rule by rule, then record, field and position;
    the field-name rules come last, record by record."""
    first_context = len((detector or Detector()).rules)
    return [
        F.col("source_id"),
        F.least(F.col("rule_rank"), F.lit(first_context)),
        F.col("record_index"),
        F.col("field_ordinal"),
        F.col("item_ordinal"),
        F.col("rule_rank"),
        F.col("char_start"),
    ]


# --- spans of an external analyzer ------------------------------------------

SPANS_SCHEMA = "array<struct<label:string,start:int,end:int,score:double>>"


def label_to_entity(label: Column) -> Column:
    """Entity type of an analyzer label; an entity type's own name passes, others raise."""
    pairs = [F.lit(x) for pair in R.LABEL_MAP.items() for x in pair]
    own = F.when(label.isin(*R.ENTITY_TYPES), label)
    return F.coalesce(F.create_map(*pairs)[label], own, F.when(label.isNotNull(), F.raise_error(
        F.concat(F.lit("not a valid entity type: "), label)).cast("string")))


def wanted_labels(entities: Iterable[str] | None = None) -> tuple[str, ...]:
    """Labels asked of the analyzer; the caller's list or one label per entity type."""
    return tuple(entities or ()) or R.DEFAULT_LABELS


def external_detections(texts: DataFrame, spans: DataFrame, key: str,
                        text: str = "text", entities: Iterable[str] | None = None) -> DataFrame:
    """Detections from a table of analyzer spans ``(key, label, start, end, score)``.

    Only the requested labels are read.  A span is cut out of its own text, so
    the join is on ``key``; a text with very many spans is salted.
    """
    chosen = spans.filter(F.col("label").isin(*wanted_labels(entities))).select(key, "label", "start", "end", "score")
    return join_many_to_one(chosen, texts.select(key, text), key, F.col("start")).select(
        key, *_span_fields(F.col(text), F.col("label"), F.col("start"), F.col("end"), F.col("score")))


def _span_fields(text: Column, label: Column, start: Column, end: Column, score: Column) -> list[Column]:
    return [
        label_to_entity(label).alias("entity_type"),
        F.substring(text, start + 1, end - start).alias("value"),
        F.lit(ROOT_PATH).alias("field_path"),
        start.cast("int").alias("char_start"),
        end.cast("int").alias("char_end"),
        score.alias("confidence"),
        F.lit("presidio").alias("detector_name"),
    ]


class ExternalDetector:
    """Runs an analyzer over every text, or every record written out as text, in Arrow batches.

    ``analyzer(text, labels)`` returns ``(label, start, end, score)`` tuples.
    It is the one place where Python sees the texts.  Hits sit at the root, so
    whole texts are rewritten while the fields of structured records are not.
    """

    rules: tuple = ()

    def __init__(self, analyzer: Callable, entities: Iterable[str] | None = None):
        self.analyzer, self.labels = analyzer, list(wanted_labels(entities))

    def candidate_text(self, value: str, dtype: T.DataType) -> str | None:
        return value if is_text(dtype) else None

    def annotate(self, records: DataFrame) -> DataFrame:
        analyzer, labels = self.analyzer, self.labels

        @F.pandas_udf(SPANS_SCHEMA)
        def spans_of(batch: pd.Series) -> pd.Series:
            return batch.map(lambda t: [] if t is None else [
                {"label": s[0], "start": s[1], "end": s[2], "score": s[3]} for s in analyzer(t, labels)])

        def hit(span: Column, i: Column) -> Column:
            fields = dict(zip(("entity_type", "value", "field_path", "char_start", "char_end", "confidence",
                               "detector_name"), _span_fields(F.col("_text"), *[
                                   span[f] for f in ("label", "start", "end", "score")])))
            fields |= {"field_ordinal": F.lit(0), "item_ordinal": F.lit(0), "rule_rank": i}
            return F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in HIT_TYPE.fields])

        return (
            records.withColumn("_text", F.expr(record_text(records.schema["content"].dataType)))
            .withColumn("_spans", spans_of("_text"))
            .withColumn("hits", F.coalesce(F.transform("_spans", hit), F.expr(NO_HITS)))
            .drop("_text", "_spans")
        )
