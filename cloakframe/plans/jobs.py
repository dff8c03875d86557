"""Whole jobs: scan, sanitize, report, batch over a folder, query scan.

Each job reads its source and evaluates the rules once.  What several outputs
need (the sanitized content, the hits with previews) is written once to a
staging table in the shared folder, and every output is a column-pruned read of
it.  Staged tables are removed when the job ends.  Outputs replace those of an
earlier run over the same sources.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_preview
from ..operators import report as rep
from ..operators.detect import Detector, ExternalDetector, annotate
from ..operators.json_paths import annotate_json, is_json_text, write_back_json
from ..operators.pseudonyms import PseudonymStore, pseudonymize_with
from ..operators.records import index_records, texts_from
from ..operators.sanitize import protect_hits, write_back
from ..rules import REPORT_FORMATS, check_mode
from ..shared import cut, scratch
from ..sinks.write import write_report, write_sanitized
from ..sources import csv, files, json, text
from ..sources.query import load_query


AnyDetector = Detector | ExternalDetector


def protect(annotated: DataFrame, mode: str, detector: AnyDetector,
            store: PseudonymStore | None = None) -> DataFrame:
    """Give every hit its sanitized value in any mode; new pseudonyms are saved before any is used.

    Pseudonyms need a ``store`` in a place the caller names and keeps.
    """
    if check_mode(mode) != "pseudonymize":
        return protect_hits(annotated, mode)
    if store is None:
        raise ValueError("mode pseudonymize needs a PseudonymStore: the map must outlive the run")
    return pseudonymize_with(annotated, store, detector)


def audited(df: DataFrame, transformed: bool) -> DataFrame:
    """Replace raw values in ``hits`` by previews."""

    def preview(h):
        kept = [h[f].alias(f) for f in (
            "field_ordinal", "item_ordinal", "field_path", "rule_rank", "entity_type",
            "char_start", "char_end", "confidence", "detector_name")]
        after = safe_preview(h["sanitized"]) if transformed else F.lit(None).cast("string")
        return F.struct(*kept, safe_preview(h["value"]).alias("value_preview"), after.alias("sanitized_preview"))

    return df.withColumn("hits", F.transform("hits", preview))


def annotated(records: DataFrame, detector: AnyDetector | None, input_format: str | None) -> DataFrame:
    """The records with their hits; JSON records may be structs or JSON texts."""
    return annotate_json(records, detector) if is_json_text(records, input_format) else annotate(records, detector)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder, read back, and resolve row positions."""
    return index_records(cut(df, name))


def _complete(summary: DataFrame, sources: DataFrame | None, input_format: str) -> DataFrame:
    """Keep sources that gave no record at all."""
    if sources is None:
        return summary.withColumn("input_format", F.lit(input_format))
    known = sources.select("source_id").withColumn("input_format", F.lit(input_format))
    # A list without items counts no record; a text counts one even when it is empty.
    return known.join(summary, "source_id", "left") \
        .fillna(0 if input_format in ("csv", "json") else 1, ["record_count"]) \
        .fillna(0, ["entities_found", *rep.SORTED_TYPES])


def _write_audit(rows: DataFrame, sources: DataFrame | None, input_format: str, mode: str, out_dir: str,
                 sanitized: bool, transformed: bool, report_format: str) -> None:
    if report_format not in REPORT_FORMATS:
        raise ValueError(f"{report_format!r} is not one of {', '.join(REPORT_FORMATS)}")
    summary = cut(_complete(rep.source_summary(rows), sources, input_format), "summary")
    # The order of a listing can be restored from its ordinals.
    hits = rows.filter(F.size("hits") > 0).select("source_id", "record_index", F.inline("hits"))
    order = ("rule_rank", "field_ordinal", "item_ordinal")
    names = summary.select("source_id")
    if report_format == "html":  # the report for people: header facts and one short row per detection
        write_report(summary.select("source_id", *rep.header_facts(mode)), mode, f"{out_dir}/reports", report_format, names)
        write_report(hits.select("source_id", *rep.listing_facts(), *order), mode, f"{out_dir}/display", report_format, names)
        return
    report = rep.audit_report(summary, mode, out_dir, sanitized, report_format=report_format)
    write_report(report, mode, f"{out_dir}/reports", report_format, names)
    write_report(hits.select(
        "source_id", "entity_type", "field_path", "record_index", "char_start", "char_end",
        "confidence", "detector_name", "value_preview", *order), mode, f"{out_dir}/detections", report_format, names)
    if transformed:
        write_report(hits.select(
            "source_id", "entity_type", F.lit(mode).alias("mode"), "field_path", "record_index",
            "sanitized_preview", "char_start", *order), mode, f"{out_dir}/transformations", report_format, names)


_AUDIT = ("source_id", "record_index", "units", "hits")


def _audit_columns(df: DataFrame) -> list[str]:
    return [*_AUDIT, *(["position"] if "position" in df.columns else [])]


def scan(records: DataFrame, detector: AnyDetector | None = None, input_format: str | None = None) -> DataFrame:
    """Counts per source; nothing is written."""
    return rep.source_summary(annotated(records, detector, input_format))


def sanitize(records: DataFrame, input_format: str, mode: str, out_dir: str, detector: AnyDetector | None = None,
             store: PseudonymStore | None = None, sources: DataFrame | None = None,
             report_format: str = "json") -> None:
    """Write the sanitized sources, their reports and both listings."""
    with scratch(records.sparkSession):
        detector = detector or Detector()
        protected = protect(annotated(records, detector, input_format), mode, detector, store)
        written = write_back_json(protected) if is_json_text(records, input_format) else write_back(protected, detector)
        rows = staged(audited(written, True), "sanitize")
        write_sanitized(rows, input_format, mode, f"{out_dir}/sanitized")
        _write_audit(rows, sources, input_format, mode, out_dir, True, True, report_format)


def report(records: DataFrame, input_format: str, mode: str, out_dir: str, detector: AnyDetector | None = None,
           sources: DataFrame | None = None, report_format: str = "json") -> None:
    """Write reports and the detection listing; no sanitized output, no transformations."""
    with scratch(records.sparkSession):
        found = annotated(records, detector, input_format)
        rows = staged(audited(found.select(*_audit_columns(found)), False), "report")
        _write_audit(rows, sources, input_format, mode, out_dir, False, False, report_format)


def query_scan(spark: SparkSession, query: str, mode: str, out_dir: str, url: str | None = None,
               key: str | None = None, options: Mapping[str, str] | None = None, detector: AnyDetector | None = None,
               store: PseudonymStore | None = None, report_format: str = "json") -> None:
    """Scan a query's rows: transformations are listed and pseudonyms kept, no data is written."""
    with scratch(spark):
        detector = detector or Detector()
        records = load_query(spark, query, url, key, options)
        protected = protect(annotate(records, detector), mode, detector, store)
        rows = staged(audited(protected.select(*_audit_columns(protected)), True), "query")
        _write_audit(rows, None, "db", mode, out_dir, False, True, report_format)


def load_path(spark: SparkSession, path: str, input_format: str | None = None, multi_line: bool = True,
              schema: str | None = None, json_lines: bool = False, by_path: bool = False) -> DataFrame:
    """Records of one file, by its suffix.

    ``multi_line=False`` (CSV) and ``json_lines=True`` read large files in
    splits; ``schema`` of the JSON records saves the pass that finds it.
    ``by_path=True`` keeps JSON records as texts, so that every value keeps its
    own type, keys their order, and a missing key is not a null.
    """
    fmt = input_format or files.infer_format(path)
    if fmt == "csv":
        return csv.load_csv(spark, path, multi_line=multi_line)
    if fmt == "json":
        return json.load_json_text(spark, path, json_lines) if by_path else json.load_json(spark, path, schema, json_lines)
    if fmt in ("txt", "sql"):
        return text.load_text(spark, path, fmt)
    raise ValueError("PDF input is a table of extracted pages; see sources.text.assemble_pages")


def folder_records(spark: SparkSession, folder: str, pages: DataFrame | None = None, multi_line: bool = True,
                   schema: str | None = None, json_lines: bool = False,
                   by_path: bool = False) -> Iterator[tuple[str, DataFrame, DataFrame | None]]:
    """``(format, records, sources)`` for every format in a folder.

    All files of a format are one read; CSV files are one read per distinct
    header.  ``pages`` holds the extracted pages of the PDF files, as
    ``source_id, page_no, text``.
    """
    listed = files.list_files(spark, folder)
    present = {r["input_format"] for r in listed.select("input_format").distinct().collect()}
    for fmt in sorted(present - {"pdf"}):
        sources = listed.filter(F.col("input_format") == fmt)
        if fmt == "csv":
            for records, files_read in csv.load_csv_groups(spark, folder, sources, multi_line):
                yield fmt, records, files_read
        elif fmt == "json":
            yield fmt, load_path(spark, folder, fmt, multi_line, schema, json_lines, by_path), sources
        else:
            yield fmt, text.load_text(spark, folder, fmt), sources
    if pages is not None:
        texts = text.assemble_pages(pages, "source_id", "page_no", "text")
        yield "pdf", texts_from(texts, F.col("source_id"), "text"), None


def batch(spark: SparkSession, folder: str, action: str, mode: str = "mask", out_dir: str = "outputs",
          detector: AnyDetector | None = None, store: PseudonymStore | None = None, pages: DataFrame | None = None,
          report_format: str = "json", multi_line: bool = True, schema: str | None = None,
          json_lines: bool = False, by_path: bool = False) -> list[DataFrame]:
    """``scan``, ``sanitize`` or ``report`` over a folder; an empty folder is a no-op.

    The read options are those of ``load_path``.

    ``scan`` returns one summary per read, the other actions write and return nothing.
    """
    if action not in ("scan", "sanitize", "report"):
        raise ValueError(f"{action!r} is not one of scan, sanitize, report")
    summaries = []
    for fmt, records, sources in folder_records(spark, folder, pages, multi_line, schema, json_lines, by_path):
        if action == "scan":
            summaries.append(_complete(scan(records, detector, fmt), sources, fmt))
        elif action == "report":
            report(records, fmt, mode, out_dir, detector, sources, report_format)
        else:
            sanitize(records, fmt, mode, out_dir, detector, store, sources, report_format)
    return summaries
