"""Records kept as JSON texts against a plain walk over the parsed document."""

import copy
import glob
import json

import pytest
from plain_python import find, mask
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.operators.detect import Detector, ExternalDetector, detections
from cloakframe.operators.json_paths import SLICE_ROWS, annotate_json, write_back_json
from cloakframe.operators.pseudonyms import PseudonymStore
from cloakframe.operators.sanitize import protect_hits
from cloakframe.plans import jobs

RECORDS = [
    {"b": 1, "a": "mail a@b.it, again a@b.it"}, {"a": 3331234567, "b": None}, {"a": True, "b": [1, ["x@y.it", {"c": "10.0.0.1"}], None]},
    {"a": {"full_name": "Mario Rossi", "e.mail": "m@r.it"}, "a.full_name": "Anna Bianchi"}, {}, {"a": []}, {"a": {}}, {"": {"": "q@r.it"}},
    {"a": 1.5, "b": -3331234567, "c": 1e300, "d": 12345678901234567890123}, {"a": "è ü 😀 via a@b.it", "A": "A@B.IT"},
    {"a": " Mario Rossi ", "full_name": " Mario Rossi "}, {"a": "1985-06-14 192.168.100.42"}, {"address": ["Via Roma 10"], "deep": [[[["p@q.it"]]]]},
    {"value": "x" * 5000 + " u@v.it " + "y" * 5000}, {"a": "a@b.it"}, {"a": "a@b.it"}]


def walk(value, path=(), shown=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*path, k), f"{shown}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, (*path, i), f"{shown}[{i}]")
    else:
        yield path, shown, value


def expected(record):
    """Hits and masked record, by definition."""
    done, hits = copy.deepcopy(record), []
    for ordinal, (path, shown, value) in enumerate(walk(record)):
        if value is None:
            continue
        name = str(path[-1])  # a hint may be the last word of a name
        found = find(str(value), name.endswith("full_name"), name == "address")
        hits += [(ordinal, shown, *h) for h in found]
        holder = done
        for part in path[:-1]:
            holder = holder[part]
        for kind, old, *_ in found:
            now = holder[path[-1]]
            holder[path[-1]] = now.replace(old, mask(old, kind)) if isinstance(now, str) else mask(old, kind)
    return hits, done


def as_records(spark, texts):
    schema = "source_id string, record_index bigint, units bigint, content string"
    return spark.createDataFrame([("s", i, 1, t) for i, t in enumerate(texts)], schema)


def test_hits_and_masks_equal_a_plain_walk(spark):
    # More records than a slice, with one that is longer than the others.
    records = RECORDS * (SLICE_ROWS // len(RECORDS) + 2)
    annotated = annotate_json(as_records(spark, [json.dumps(r) for r in records]).coalesce(1))
    got = {}
    for h in detections(annotated).collect():
        got.setdefault(h["record_index"], []).append(
            (h["field_ordinal"], h["field_path"], h["entity_type"], h["value"], h["char_start"], h["char_end"]))
    done = {r["record_index"]: r["content"] for r in write_back_json(protect_hits(annotated, "mask")).collect()}
    wanted = [expected(r) for r in RECORDS]
    for i, record in enumerate(records):
        hits, masked = wanted[i % len(RECORDS)]
        assert sorted(got.get(i, [])) == sorted(hits), record
        # As text: the order of the keys and the types count too.
        assert json.dumps(json.loads(done[i])) == json.dumps(masked), record


def test_nulls_and_untouched_records(spark):
    texts = [None, "{}", '{"a": 1.10, "b":  "x"}']
    annotated = annotate_json(as_records(spark, texts))
    assert detections(annotated).count() == 0
    done = write_back_json(protect_hits(annotated, "redact")).orderBy("record_index").collect()
    assert [r["content"] for r in done] == texts  # also their blanks and spelling
    none = annotate_json(as_records(spark, []))
    assert write_back_json(protect_hits(none, "mask")).collect() == []


def test_custom_rules_and_chosen_entities(spark):
    records = as_records(spark, ['{"a": true, "n": 17, "mail": "a@b.it"}'])
    detector = Detector(spark, {"TAX_CODE": "True"}, ["EMAIL", "TAX_CODE"])
    found = detections(annotate_json(records, detector)).collect()
    assert {(h["entity_type"], h["field_path"]) for h in found} == {("TAX_CODE", "a"), ("EMAIL", "mail")}


def test_external_hits_leave_the_record_alone(spark):
    records = as_records(spark, ['{"a": "Mario"}'])
    annotated = annotate_json(records, ExternalDetector(lambda t, labels: [("PERSON", t.index("Mario"), t.index("Mario") + 5, 0.9)]))
    assert [h["value"] for h in detections(annotated).collect()] == ["Mario"]
    assert write_back_json(protect_hits(annotated, "mask")).first()["content"] == '{"a": "Mario"}'


@pytest.mark.parametrize("mode", ["redact", "pseudonymize"])
def test_batch_keeps_types_order_and_missing_keys(spark, tmp_path, mode):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "list.json").write_text('[{"b":1,"a":"a@b.it"},{"a":7},5,{"a":{"x":null}},{"a":NaN}]', encoding="utf-8")
    (folder / "lines.json").write_text('{"z":"a@b.it"}\n{"a":[1,"c@d.it"],"z":2}\n', encoding="utf-8")
    store = PseudonymStore(spark, str(tmp_path / "map")) if mode == "pseudonymize" else None
    (summary,) = jobs.batch(spark, str(folder), "scan", by_path=True)
    assert {r["source_id"].rsplit("/")[-1]: (r["record_count"], r["entities_found"]) for r in summary.collect()} == {
        "list.json": (5, 1), "lines.json": (2, 2)}
    for _ in range(2):  # a second run replaces the first
        jobs.batch(spark, str(folder), "sanitize", mode, out, store=store, by_path=True)
    written = {}
    for name in ("list", "lines"):
        parts = sorted(glob.glob(f"{out}/sanitized/output_file={name}_{mode}_sanitized.json/source=*/part-*"))
        written[name] = [line for p in parts for line in open(p, encoding="utf-8").read().splitlines()]
    first, second = ("[REDACTED_EMAIL]",) * 2 if mode == "redact" else ("EMAIL_001", "EMAIL_002")
    assert written["lines"] == ['{"z":"%s"}' % first, '{"a":[1,"%s"],"z":2}' % second]
    assert written["list"] == ['{"b":1,"a":"%s"}' % first, '{"a":7}', '{"value":5}', '{"a":{"x":null}}', '{"a":"NaN"}']


def test_nothing_is_shuffled(spark):
    plan = write_back_json(protect_hits(annotate_json(as_records(spark, ['{"a":1}'])), "mask"))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and shown.count("MapInArrow") == 2
    assert isinstance(plan.schema["content"].dataType, T.StringType) and plan.filter(F.col("content").isNull()).count() == 0
