"""Cells, wide and nested records, pseudonyms, joins, spans, previews, names, streams."""

import random

import pytest
from pyspark.sql import functions as F

import plain_python as plain
from cloakframe import shared
from cloakframe.functions.text import name_fits, normalize_name, safe_preview
from cloakframe.operators import pseudonyms as ps
from cloakframe.operators.cells import cell_table, variant_cells
from cloakframe.operators.detect import (Detector, ExternalDetector, annotate, detect, detection_order, detections,
                                         external_detections)
from cloakframe.operators.records import records_from, texts_from
from cloakframe.operators.report import audit_report, source_summary
from cloakframe.operators.sanitize import protect_hits, write_back
from cloakframe.rules import ADDRESS_HINTS, PERSON_NAME_HINTS
from cloakframe.sources import files

# Published sample values.
DOC = {
    "full_name": "Mario Rossi", "birth_date": "1985-06-14", "address": " Via Roma 10 ", "ip_address": "192.168.100.42",
    "email": "mario.rossi@example.it", "phone": "02 1234 56", "tax_code": "RSSMRA85M01H501Z",
    "iban": "IT60X0542811101000000123456",
}


def test_all_types_on_one_record(spark):
    found = detect(records_from(spark.createDataFrame([DOC]), "s")).orderBy(*detection_order()).collect()
    assert [r["entity_type"] for r in found] == [
        "EMAIL", "PHONE", "TAX_CODE", "IBAN", "BIRTH_DATE", "IP_ADDRESS", "ADDRESS", "PERSON_NAME"]
    row = write_back(protect_hits(annotate(records_from(spark.createDataFrame([DOC]), "s")), "mask")).first()["content"]
    assert row["address"] == " V*a R**a ** " and row["ip_address"] == "192.16*.100.42" and row["phone"] == "02 1234 56"


def test_a_wide_record_gives_the_same_hits_as_a_narrow_one(spark):
    rng = random.Random(3)
    fields = [*DOC, *[f"f{i}" for i in range(60)]]
    rows = [[rng.choice([*DOC.values(), None, "x", "12"]) for _ in fields] for _ in range(40)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                  "id int, " + ", ".join(f"{f} string" for f in fields))
    wide = detect(records_from(frame, "s", "id", fields))
    expected = sorted(
        (i, f, *h) for i, r in enumerate(rows) for f, v in zip(fields, r) if v is not None
        for h in plain.find(v, name_fits(PERSON_NAME_HINTS, f), name_fits(ADDRESS_HINTS, f)))
    got = sorted(tuple(r) for r in wide.select(
        "record_index", "field_path", "entity_type", "value", "char_start", "char_end").collect())
    assert got == expected


def test_nested_lists_and_maps(spark):
    frame = spark.sql("""select 1 as id, array(named_struct('email', 'a@b.it', 'n', 12345678L), null) as contacts,
        map('Contact Name', 'Anna Bianchi', 'k', null) as extra, named_struct('x', array(array('c@d.it'))) as deep,
        cast(null as struct<e:string>) as gone""")
    records = records_from(frame, "s", "id", ["contacts", "extra", "deep", "gone"])
    assert [(r["field_path"], r["field_name"], r["value"]) for r in cell_table(records).orderBy("field_ordinal").collect()] == [
        ("contacts[0].email", "email", "a@b.it"), ("contacts[0].n", "n", "12345678"),
        ("extra.Contact Name", "Contact Name", "Anna Bianchi"), ("deep.x[0][0]", None, "c@d.it")]
    done = write_back(protect_hits(annotate(records), "redact")).first()["content"].asDict(True)
    assert done == {
        "contacts": [{"email": "[REDACTED_EMAIL]", "n": "[REDACTED_PHONE]"}, None],
        "extra": {"Contact Name": "[REDACTED_PERSON_NAME]", "k": None}, "deep": {"x": [["[REDACTED_EMAIL]"]]}, "gone": None}


def test_variant_depth_is_never_cut_silently(spark):
    frame = spark.sql("""select 's' as source_id, 0L as record_index, parse_json('{"a":{"b":{"c":1}},"e":{},"l":[]}') as content""")
    assert [(r["field_path"], r["value"]) for r in variant_cells(frame, 3).collect()] == [("a.b.c", "1")]
    with pytest.raises(Exception, match="nested deeper"):
        variant_cells(frame, 2).collect()


def test_names_and_hints():
    assert normalize_name("  Full--Name! ") == "full_name"
    assert name_fits(PERSON_NAME_HINTS, "Customer Name") and name_fits(PERSON_NAME_HINTS, "name_2")
    assert not name_fits(PERSON_NAME_HINTS, "username") and not name_fits(PERSON_NAME_HINTS, "nameless")


def test_previews_and_file_names(spark):
    rows = spark.createDataFrame([("abcd",), ("abcde",), ("",)], "v string").select(safe_preview(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["****", "ab***de", ""]
    path = F.col("p")
    row = spark.createDataFrame([("file:///x/My%20a+b.v1.PDF",)], "p string").select(
        files.file_name(path), files.format_of(path), files.sanitized_name(path, "mask"),
        files.report_name(path, "mask", "html")).first()
    assert tuple(row) == ("My a+b.v1.PDF", "pdf", "My a+b.v1_mask_sanitized.txt", "My a+b.v1_mask_report.html")
    assert files.infer_format("/a/b.CSV") == "csv"
    for bad in ("/a/b", "/a/b.exe", "/a/.csv"):
        with pytest.raises(ValueError):
            files.infer_format(bad)


def test_zero_hits_report(spark):
    frame = spark.createDataFrame([("a.txt", "nothing here"), ("b.txt", "x@y.it")], "f string, t string")
    rows = audit_report(source_summary(annotate(texts_from(frame, F.col("f"), "t"))), "mask", "o",
                        input_format="txt").orderBy("source_id").collect()
    assert rows[0]["confidence"] is None and rows[0]["entity_counts"] == {} and rows[0]["record_count"] == 1
    assert rows[1]["entity_counts"] == {"EMAIL": 1} and rows[1]["confidence"]["average"] == pytest.approx(0.9)


def test_external_spans(spark):
    text = "My email is mario.rossi@example.it"
    texts = spark.createDataFrame([(1, text)], "id int, text string")
    spans = spark.createDataFrame([(1, "EMAIL_ADDRESS", 12, len(text), 0.99), (1, "IBAN", 0, 2, 0.5), (1, "PERSON", 0, 2, 0.1)],
                                  "id int, label string, start int, end int, score double")
    (hit,) = external_detections(texts, spans, "id", entities=["EMAIL_ADDRESS"]).collect()
    assert (hit["entity_type"], hit["value"], hit["confidence"], hit["detector_name"]) == (
        "EMAIL", "mario.rossi@example.it", 0.99, "presidio")
    assert {r["entity_type"] for r in external_detections(texts, spans, "id", entities=["IBAN", "PERSON"]).collect()} == {
        "IBAN", "PERSON_NAME"}
    with pytest.raises(Exception, match="not a valid entity type"):
        external_detections(texts, spans.replace("IBAN", "DOG"), "id", entities=["DOG"]).collect()

    def fake_analyzer(t, labels):
        assert labels == ["EMAIL_ADDRESS"]
        return [("EMAIL_ADDRESS", t.index("mario"), len(t), 0.99)]

    detector = ExternalDetector(fake_analyzer, ["EMAIL_ADDRESS"])
    found = annotate(texts_from(texts, F.col("id"), "text"), detector)
    (hit,) = detections(found).collect()
    assert hit["value"] == "mario.rossi@example.it" and hit["field_path"] == "<root>" and hit["confidence"] == 0.99
    done = write_back(protect_hits(found, "redact"), detector).first()
    assert done["content"] == "My email is [REDACTED_EMAIL]"
    record = records_from(spark.createDataFrame([(1, None, "x mario")], "n int, gone string, t string"), "s")
    found = annotate(record, detector)
    (hit,) = detections(found).collect()
    assert (hit["value"], hit["char_start"]) == ("mario", 9)  # "1", "None" and "x mario" on three lines
    assert write_back(protect_hits(found, "redact"), detector).first()["content"]["t"] == "x mario"


def _hit_rows(spark, n):
    """Emails where one value holds a third of all rows."""
    return spark.range(n).select(F.col("id"), F.expr(
        "concat(if(id % 3 = 0, 'hot', concat('u', id % 400)), '@x.it 10.0.', id % 7, '.1')").alias("t"))


def _expected_numbers(rows, known):
    ids, counters = dict(known), {}
    for (kind, _), name in known.items():
        counters[kind] = max(counters.get(kind, 0), int(name.rsplit("_", 1)[1]))
    for kind in ("EMAIL", "IP_ADDRESS"):
        for _, text in sorted(rows):
            for k, value, *_ in plain.find(text):
                if k == kind and (k, value) not in ids:
                    counters[k] = counters.get(k, 0) + 1
                    ids[k, value] = f"{k}_{counters[k]:03d}"
    return ids


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_pseudonym_numbers_follow_first_sight(spark, monkeypatch, broadcast_rows):
    """Both join ways (broadcast, hot values apart) give the numbers of a sequential run."""
    monkeypatch.setattr(ps, "BROADCAST_ROWS", broadcast_rows)
    frame = _hit_rows(spark, 3000)
    rows = [tuple(r) for r in frame.collect()]
    annotated = annotate(records_from(frame, "s", "id", ["t"]), Detector())
    seed = {("EMAIL", "u5@x.it"): "EMAIL_007", ("EMAIL", "other@x.it"): "EMAIL_041"}
    known = spark.createDataFrame([(k, v, int(n[-3:]), n) for (k, v), n in seed.items()], ps.MAP_SCHEMA)
    protected, new = ps.pseudonymize_hits(annotated, known)
    expected = _expected_numbers(rows, seed)
    assert {(r["entity_type"], r["value"]): r["pseudonym"] for r in new.collect()} == {
        k: v for k, v in expected.items() if k not in seed}
    done = {r[0]: r[1] for r in write_back(protected).select("record_index", "content.t").collect()}
    assert done == {i: plain.sanitize(t, plain.find(t), lambda v, k: expected[k, v]) for i, t in rows}


def test_salted_lookup_join_keeps_every_row(spark, monkeypatch):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    small = shared.lookup_join(left, right, ["k"], F.col("id"))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    salted = shared.lookup_join(left, right, ["k"], F.col("id"))
    assert sorted(map(str, small.collect())) == sorted(map(str, salted.select(*small.columns).collect()))
    assert salted.count() == 1000


def test_hot_keys_are_salted_in_many_to_one_joins(spark, monkeypatch):
    many = spark.range(4000).select(F.expr("if(id % 3 = 0, 0, id % 50)").alias("k"), F.col("id").alias("start"))
    one = spark.range(60).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("v"))
    plain_join = sorted(map(tuple, one.join(many, "k").select("k", "start", "v").collect()))
    for limit in (200_000, 0):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", limit)
        got = shared.join_many_to_one(many, one, "k", F.col("start")).select("k", "start", "v")
        assert sorted(map(tuple, got.collect())) == plain_join


def test_odd_column_names(spark, tmp_path):
    from cloakframe.plans import jobs
    (tmp_path / "odd.csv").write_text('a.b,"x,y;z",`q`,full name\nm@n.it,1,2,Anna Bianchi\n', encoding="utf-8")
    out = str(tmp_path / "out")
    jobs.sanitize(jobs.load_path(spark, str(tmp_path / "odd.csv")), "csv", "redact", out)
    (row,) = spark.read.option("header", True).csv(f"{out}/sanitized/output_file=odd_redact_sanitized.csv/source=*").collect()
    assert list(row.asDict().items()) == [
        ("a.b", "[REDACTED_EMAIL]"), ("x,y;z", "1"), ("`q`", "2"), ("full name", "[REDACTED_PERSON_NAME]")]


def test_rules_are_evaluated_once_per_record(spark):
    """No plan repeats the pattern search for a filter or an unfolding."""
    frame = spark.createDataFrame([(1, "a@b.it")], "id int, t string")
    annotated = annotate(records_from(frame, "s", "id", ["t"]))
    once = annotated._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    for df in (detections(annotated), source_summary(annotated), write_back(protect_hits(annotated, "mask"))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == once


def test_narrow_operators_do_not_shuffle(spark):
    frame = spark.createDataFrame([(1, "a@b.it")], "id int, t string")
    done = write_back(protect_hits(annotate(records_from(frame, "s", "id", ["t"])), "redact"))
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_records_can_be_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a@b.it"), (2, "none")], "id int, t string").write.parquet(source)
    stream = spark.readStream.schema("id int, t string").parquet(source)
    done = write_back(protect_hits(annotate(records_from(stream, "s", "id", ["t"])), "redact")).select("content.t")
    query = done.writeStream.format("memory").queryName("done").trigger(availableNow=True) \
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("done").collect()) == ["[REDACTED_EMAIL]", "none"]
