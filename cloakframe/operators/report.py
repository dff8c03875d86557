"""Audit reports: aggregates and listings that never show a raw value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_preview
from ..rules import ENTITY_TYPES, check_mode
from ..sources.files import file_name, report_name, sanitized_name

SORTED_TYPES = sorted(ENTITY_TYPES)
_EXACT = "decimal(20,10)"


def entity_counts(found: DataFrame) -> DataFrame:
    """Hits per source and entity type."""
    return found.groupBy("source_id", "entity_type").agg(F.count("*").alias("entity_count"))


def detection_totals(found: DataFrame) -> DataFrame:
    """Hits per source."""
    return found.groupBy("source_id").agg(F.count("*").alias("entities_found"))


def confidence_summary(found: DataFrame) -> DataFrame:
    """Average, lowest and highest confidence per source.

    The sum is kept as a decimal, so the average does not depend on the order
    in which partitions arrive.
    """
    return found.groupBy("source_id").agg(
        (F.sum(F.col("confidence").cast(_EXACT)).cast("double") / F.count("confidence")).alias("average"),
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
    )


def source_summary(annotated: DataFrame) -> DataFrame:
    """One row per source from one pass over the records.

    The hit arrays are aggregated where they are: no unfolding, no join, and a
    shuffle of one partial row per task and source.  A source without a hit
    keeps its row, with zero counts and null confidences.
    """
    counts = [
        f"sum(if(size(hits) > 0, size(filter(hits, h -> h.entity_type = '{t}')), 0)) AS {t}" for t in SORTED_TYPES]
    scores = "if(size(hits) > 0, transform(hits, h -> h.confidence), null)"
    total = f"aggregate({scores}, cast(0 as {_EXACT}), (a, c) -> cast(a + cast(c as {_EXACT}) as {_EXACT}))"
    grouped = annotated.groupBy("source_id").agg(*[F.expr(e) for e in (
        "sum(units) AS record_count", "sum(size(hits)) AS entities_found", *counts,
        f"cast(sum({total}) as double) AS _total",
        f"min(array_min({scores})) AS min", f"max(array_max({scores})) AS max")])
    return grouped.select(
        "source_id", "record_count", "entities_found", *SORTED_TYPES,
        F.when(F.col("entities_found") > 0, F.col("_total") / F.col("entities_found")).alias("average"),
        "min", "max",
    )


def audit_report(summary: DataFrame, mode: str, output_dir: str = "outputs", sanitized: bool = True,
                 input_format: str | Column | None = None, report_format: str = "json") -> DataFrame:
    """The report row of every source.

    ``sanitized`` tells whether a sanitized output exists; a report-only run
    names no output file.
    """
    check_mode(mode)
    source = F.col("source_id")
    fmt = F.col("input_format") if input_format is None else (
        F.lit(input_format) if isinstance(input_format, str) else input_format)
    output = F.concat(F.lit(output_dir.rstrip("/") + "/"), sanitized_name(source, mode)) if sanitized \
        else F.lit(None).cast("string")
    report = F.concat(F.lit(output_dir.rstrip("/") + "/"), report_name(source, mode, report_format))
    counts = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(t) for t in SORTED_TYPES]), F.array(*[F.col(t) for t in SORTED_TYPES])),
        lambda _, n: n > 0)
    return summary.select(
        "source_id",
        file_name(source).alias("input_file"),
        fmt.alias("input_format"),
        "record_count",
        F.lit(mode).alias("sanitization_mode"),
        "entities_found",
        counts.alias("entity_counts"),
        F.when(F.col("entities_found") > 0, F.struct("average", "min", "max")).alias("confidence"),
        output.alias("output_file"),
        report.alias("report_file"),
        F.struct(output.alias("sanitized_file"), report.alias("report_file")).alias("planned_outputs"),
        F.lit(sanitized).alias("sanitized_output_generated"),
    )


def detection_listing(found: DataFrame) -> DataFrame:
    """Detections with a preview in place of the value."""
    return found.select(
        "source_id", "entity_type", "field_path", "record_index", "char_start", "char_end",
        "confidence", "detector_name", safe_preview(F.col("value")).alias("value_preview"))


def transformation_listing(applied: DataFrame) -> DataFrame:
    """Applied replacements with a preview of the new value."""
    return applied.select(
        "source_id", "entity_type", "mode", "field_path", "record_index",
        safe_preview(F.col("sanitized")).alias("sanitized_preview"))


def listing_facts() -> list[Column]:
    return [file_name(F.col("source_id")).alias("input_file"), F.col("entity_type").alias("type"),
            F.col("field_path").alias("field"), F.col("record_index").alias("record")]


def display_listing(found: DataFrame) -> DataFrame:
    """Rows of the human-readable report."""
    return found.select(*listing_facts())


def header_facts(mode: str) -> list[Column]:
    return [file_name(F.col("source_id")).alias("input_file"), F.lit(check_mode(mode)).alias("sanitization_mode"),
            F.col("entities_found").alias("total_detections")]


def display_header(summary: DataFrame, mode: str) -> DataFrame:
    """Header facts of the human-readable report."""
    return summary.select(*header_facts(mode))
