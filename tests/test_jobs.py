"""End-to-end jobs on small files and queries."""

import glob
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.detect import Detector, annotate, detect
from cloakframe.operators.pseudonyms import PseudonymStore
from cloakframe.plans import jobs, queries
from cloakframe.sinks import write
from cloakframe.sources import csv, json as json_source, text

# The published sample file, row for row.
CUSTOMERS = (
    "\ufeffrecord_id,full_name,birth_date,address,ip_address,email,phone,tax_code,iban,notes\n"
    "1,Mario Rossi,1985-06-14,Via Roma 10,192.168.1.42,mario.rossi@gmail.com,+39 3331234567,"
    "RSSMRA85M01H501Z,IT60X0542811101000000123456,Synthetic training record\n"
    "2,Anna Bianchi,1990-01-01,Viale Europa 25,10.24.8.15,anna.bianchi@example.it,+39 3477654321,"
    "BNCNNA90A41F205X,IT40S0300203280280000400235,Synthetic demo data\n"
    "3,Luca Verdi,1988-12-10,Piazza Garibaldi 7,172.16.4.77,luca.verdi@demo.local,+39 3205557788,"
    "VRDLCU88T10H501Q,IT18A0200803244000104005823,Local-first privacy sample\n"
)


def read_json(path):
    rows = []
    for part in sorted(glob.glob(f"{path}/**/part-*.json", recursive=True)):
        rows += [json.loads(line) for line in open(part, encoding="utf-8")]
    return rows


def test_scan_counts_every_type_three_times(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(CUSTOMERS, encoding="utf-8")
    row = jobs.scan(csv.load_csv(spark, str(tmp_path / "customers.csv"))).first()
    assert row["record_count"] == 3 and row["entities_found"] == 24
    assert all(row[t] == 3 for t in jobs.rep.SORTED_TYPES)


def test_sanitize_csv_writes_output_and_report(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(CUSTOMERS, encoding="utf-8")
    out = str(tmp_path / "out")
    jobs.sanitize(jobs.load_path(spark, str(tmp_path / "customers.csv")), "csv", "mask", out)
    rows = spark.read.csv(f"{out}/sanitized/output_file=customers_mask_sanitized.csv/source=*", header=True).orderBy(
        F.col("record_id").cast("int")).collect()
    first = rows[0].asDict()
    assert first["full_name"] == "M***o R***i" and first["birth_date"] == "1**5-**-**"
    assert first["address"] == "V*a R**a **" and first["ip_address"] == "192.***.***.42"
    assert first["email"] == "m***o.r***i@gmail.com" and first["phone"] == "+39 333****567"
    assert first["iban"].startswith("IT") and first["notes"] == "Synthetic training record"
    (report,) = read_json(f"{out}/reports")
    assert report["entities_found"] == 24 and report["sanitized_output_generated"] is True
    assert report["input_file"] == "customers.csv" and report["record_count"] == 3
    assert report["output_file"].endswith("/customers_mask_sanitized.csv")
    assert report["planned_outputs"]["sanitized_file"] == report["output_file"]
    assert set(report["entity_counts"].values()) == {3}
    listing = read_json(f"{out}/detections")
    assert len(listing) == 24 and {r["record_index"] for r in listing} == {0, 1, 2}
    assert not any("mario.rossi" in json.dumps(r) for r in listing)
    assert len(read_json(f"{out}/transformations")) == 24


def test_report_only_claims_no_output(spark, tmp_path):
    (tmp_path / "c.csv").write_text("full_name,email\nMario Rossi,mario.rossi@example.it\n", encoding="utf-8")
    out = str(tmp_path / "out")
    jobs.report(jobs.load_path(spark, str(tmp_path / "c.csv")), "csv", "mask", out)
    (report,) = read_json(f"{out}/reports")
    assert report["output_file"] is None and report["sanitized_output_generated"] is False
    assert report["planned_outputs"]["sanitized_file"] is None
    assert report["entity_counts"] == {"EMAIL": 1, "PERSON_NAME": 1}
    assert not os.path.exists(f"{out}/sanitized") and not os.path.exists(f"{out}/transformations")


def test_html_report_is_a_short_listing(spark, tmp_path):
    (tmp_path / "c.csv").write_text("full_name,email\nMario Rossi,mario.rossi@example.it\n", encoding="utf-8")
    out = str(tmp_path / "out")
    jobs.report(jobs.load_path(spark, str(tmp_path / "c.csv")), "csv", "mask", out, report_format="html")
    (header,) = read_json(f"{out}/reports")
    assert {k: header[k] for k in ("input_file", "sanitization_mode", "total_detections")} == {
        "input_file": "c.csv", "sanitization_mode": "mask", "total_detections": 2}
    assert sorted((r["type"], r["field"], r["record"]) for r in read_json(f"{out}/display")) == [
        ("EMAIL", "email", 0), ("PERSON_NAME", "full_name", 0)]
    with pytest.raises(ValueError):
        jobs.report(jobs.load_path(spark, str(tmp_path / "c.csv")), "csv", "mask", out, report_format="pdf")


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        'a,b,a\n1,"x\ny",3,4\n\n5\n"q ""z""",,7\n', encoding="utf-8")
    rows = [r["content"].asDict() for r in csv.load_csv(spark, str(tmp_path / "q.csv")).collect()]
    assert rows == [{"a": "3", "b": "x\ny"}, {"a": "", "b": ""}, {"a": "7", "b": ""}]


def test_csv_record_index_with_many_files_and_splits(spark, tmp_path):
    for f in range(3):
        lines = "\n".join(f"{f},{i}" for i in range(500 * (f + 1)))
        (tmp_path / f"f{f}.csv").write_text(f"f,i\n{lines}\n", encoding="utf-8")
    for multi_line in (True, False):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        try:
            frame = csv.load_csv(spark, str(tmp_path), multi_line=multi_line)
            rows = jobs.staged(frame, "test").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(rows) == 3000
        assert all(int(r["content"]["i"]) == r["record_index"] for r in rows)


def test_json_normalization(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        "\ufeff" + json.dumps([{"email": "mario@example.it"}, "just a string", 42, None, [1]]), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"email": "anna@example.it"}, 7]}), encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"email": "x@y.it", "n": {"k": [1, "a@b.it"]}}), encoding="utf-8")
    (tmp_path / "d.json").write_text("[]", encoding="utf-8")
    docs = spark.read.text(str(tmp_path), wholetext=True)
    rows = json_source.normalize_json(docs, F.col("_metadata.file_name"), F.col("value")).collect()
    got = sorted((r["source_id"], -1 if r["record_index"] is None else r["record_index"], r["units"],
                  json.loads(r["content"]) .__repr__()) for r in rows)
    assert got == sorted([
        ("a.json", 0, 1, repr({"email": "mario@example.it"})), ("a.json", 1, 1, repr({"value": "just a string"})),
        ("a.json", 2, 1, repr({"value": 42})), ("a.json", 3, 1, repr({"value": None})),
        ("a.json", 4, 1, repr({"value": [1]})),
        ("b.json", 0, 1, repr({"email": "anna@example.it"})), ("b.json", 1, 1, repr({"value": 7})),
        ("c.json", -1, 2, repr({"email": "x@y.it", "n": {"k": [1, "a@b.it"]}})),
    ])
    found = detect(json_source.load_json(spark, str(tmp_path))).collect()
    assert sorted((r["field_path"], r["value"]) for r in found if r["entity_type"] == "EMAIL") == [
        ("email", "anna@example.it"), ("email", "mario@example.it"), ("email", "x@y.it"), ("n.k[1]", "a@b.it")]


def test_batch_over_a_mixed_folder(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "one.csv").write_text(CUSTOMERS, encoding="utf-8")
    (folder / "two files.CSV").write_text("email,id\na@b.it,1\n", encoding="utf-8")
    (folder / "note.txt").write_text("write to mario.rossi@example.it now\r\nend\n", encoding="utf-8", newline="")
    (folder / "empty.json").write_text("[]", encoding="utf-8")
    (folder / "list.json").write_text('[{"phone": 3331234567, "ok": true}]', encoding="utf-8")
    (folder / "dump.sql").write_text("insert into t values ('anna@example.it');\n", encoding="utf-8")
    (folder / "skip.bin").write_text("x@y.it", encoding="utf-8")
    (folder / "header only.csv").write_text("email,id\n", encoding="utf-8")
    (folder / "blank.csv").write_text("\n", encoding="utf-8")
    (folder / "blank.txt").write_text("\n", encoding="utf-8")
    (folder / "zero.txt").write_bytes(b"")
    (folder / "zero.csv").write_bytes(b"")
    counts = {}
    for summary in jobs.batch(spark, str(folder), "scan"):
        for r in summary.collect():
            counts[os.path.basename(r["source_id"])] = (r["record_count"], r["entities_found"])
    assert counts == {"one.csv": (3, 24), "two%20files.CSV": (1, 1), "note.txt": (1, 1), "empty.json": (0, 0),
                      "list.json": (1, 1), "dump.sql": (1, 1),
                      "header%20only.csv": (0, 0),
                      "blank.csv": (0, 0), "blank.txt": (1, 0), "zero.txt": (1, 0), "zero.csv": (0, 0)}
    jobs.batch(spark, str(folder), "sanitize", "redact", out)
    names = {os.path.basename(p)[len("output_file="):] for p in glob.glob(f"{out}/sanitized/output_file=*")}
    names -= {"blank_redact_sanitized.txt"}
    assert names == {"one_redact_sanitized.csv", "two files_redact_sanitized.csv", "note_redact_sanitized.txt",
                     "list_redact_sanitized.json", "dump_redact_sanitized.sql"}
    (note,) = glob.glob(f"{out}/sanitized/output_file=note_redact_sanitized.txt/*/part-*")
    assert open(note, encoding="utf-8").read() == "write to [REDACTED_EMAIL] now\nend\n"
    assert read_json(f"{out}/sanitized/output_file=list_redact_sanitized.json") == [
        {"ok": True, "phone": "[REDACTED_PHONE]"}]
    reports = {r["input_file"]: r for r in read_json(f"{out}/reports")}
    assert len(reports) == 11 and reports["empty.json"]["confidence"] is None
    assert reports["empty.json"]["entity_counts"] == {} and reports["empty.json"]["record_count"] == 0
    empty = tmp_path / "none"
    empty.mkdir()
    assert jobs.batch(spark, str(empty), "scan") == []


def test_outputs_can_be_written_again(spark, tmp_path):
    """A second run replaces its own outputs; equally named sources and other formats stay apart."""
    for name, address in (("x", "a@b.it"), ("y", "c@d.it")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "same.csv").write_text(f"mail\n{address}\n", encoding="utf-8")
    out = str(tmp_path / "out")
    for _ in range(2):
        for name in ("x", "y"):
            jobs.sanitize(jobs.load_path(spark, str(tmp_path / name / "same.csv")), "csv", "mask", out)
    assert sorted(r["mail"] for r in spark.read.csv(f"{out}/sanitized/*/*", header=True).collect()) == ["*@b.it", "*@d.it"]
    assert len(read_json(f"{out}/reports")) == 2 and len(read_json(f"{out}/detections")) == 2
    (tmp_path / "x" / "same.csv").write_text("mail\nnothing\n", encoding="utf-8")
    jobs.sanitize(jobs.load_path(spark, str(tmp_path / "x" / "same.csv")), "csv", "mask", out)
    assert len(read_json(f"{out}/reports")) == 2 and len(read_json(f"{out}/detections")) == 1


def test_jobs_leave_no_staged_tables(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    (tmp_path / "c.csv").write_text("mail\nzoe@b.it\namy@b.it\nbob@b.it\n", encoding="utf-8")
    before = set(os.listdir(shared))
    out, store = str(tmp_path / "out"), PseudonymStore(spark, str(tmp_path / "map"))
    records = jobs.load_path(spark, str(tmp_path / "c.csv"))
    jobs.sanitize(records, "csv", "pseudonymize", out, store=store)
    jobs.report(records, "csv", "mask", out)
    with pytest.raises(ValueError):
        jobs.sanitize(records, "csv", "pseudonymize", out)
    with pytest.raises(ValueError):
        jobs.sanitize(records, "xml", "mask", out)
    assert set(os.listdir(shared)) == before
    assert {r["value"]: r["pseudonym"] for r in store.load().collect()} == {
        "zoe@b.it": "EMAIL_001", "amy@b.it": "EMAIL_002", "bob@b.it": "EMAIL_003"}


def test_json_loses_nothing(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a":1}\n\n{"a":2}\n{"a":3}\n', encoding="utf-8")
    (tmp_path / "keys.json").write_text('[{"a":1,"a":9}]', encoding="utf-8")
    docs = spark.read.text(str(tmp_path), wholetext=True)
    got = json_source.normalize_json(docs, F.col("_metadata.file_name"), F.col("value")).orderBy("source_id", "record_index").collect()
    assert [(r["source_id"], r["record_index"], r["content"]) for r in got] == [
        ("keys.json", 0, '{"a":9}'), ("lines.json", 0, '{"a":1}'), ("lines.json", 1, '{"a":2}'), ("lines.json", 2, '{"a":3}')]
    split = jobs.staged(json_source.load_json(spark, str(tmp_path / "lines.json"), lines=True), "t").orderBy("record_index").collect()
    assert [(r["record_index"], r["content"]["a"]) for r in split] == [(0, 1), (1, 2), (2, 3)]
    for bad in ('[{"a":1}] trailing {', '{"a":1} {"b":2}', '{"a":1}\nnot json'):
        (tmp_path / "bad.json").write_text(bad, encoding="utf-8")
        with pytest.raises(Exception, match="JSONDecodeError"):
            json_source.load_json(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_page_texts(spark):
    pages = spark.createDataFrame(
        [("d", 2, "two "), ("d", 1, "  one"), ("d", 3, None), ("d", 4, ""), ("d", 2001, "far"), ("e", 1, None)],
        "doc string, page_no int, text string")
    got = {r["doc"]: r["text"] for r in text.assemble_pages(pages, "doc", "page_no", "text").collect()}
    assert got == {"d": "one\ntwo \nfar", "e": ""}


def test_query_scan_over_jdbc_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([("Mario Rossi", "mario.rossi@example.it", "192.168.1.42")],
                               "full_name string, email string, ip_address string")
    url = "jdbc:derby:memory:pii;create=true"
    df.write.format("jdbc").option("url", url).option("dbtable", "customers").save()
    out = str(tmp_path / "jdbc")
    jobs.query_scan(spark, 'select "full_name", "email", "ip_address" from customers', "mask", out, url)
    (report,) = read_json(f"{out}/reports")
    assert report["input_file"] == "database" and report["input_format"] == "db"
    assert report["entity_counts"] == {"EMAIL": 1, "IP_ADDRESS": 1, "PERSON_NAME": 1}
    assert report["output_file"] is None
    assert {r["sanitized_preview"] for r in read_json(f"{out}/transformations")} == {"m****it", "19***42", "M*****i"}
    with pytest.raises(Exception, match="(?i)no_such"):
        jobs.query_scan(spark, "select * from no_such", "mask", out)


def test_pseudonyms_are_stable_across_runs(spark, tmp_path):
    store = PseudonymStore(spark, str(tmp_path / "map"))
    detector = Detector()

    def run(emails):
        df = spark.createDataFrame(list(enumerate(emails)), "id bigint, email string")
        records = jobs.load_query  # noqa: F841
        from cloakframe.operators.records import records_from
        from cloakframe.operators.sanitize import write_back
        annotated = annotate(records_from(df, "t", "id", ["email"]), detector)
        done = write_back(jobs.protect(annotated, "pseudonymize", detector, store), detector)
        return [r["content"]["email"] for r in done.orderBy("record_index").collect()]

    assert run(["b@x.it", "none", "a@x.it and b@x.it", "A@x.it"]) == [
        "EMAIL_001", "none", "EMAIL_002 and EMAIL_001", "EMAIL_003"]
    assert run(["z@x.it", "a@x.it", "c@x.it"]) == ["EMAIL_004", "EMAIL_002", "EMAIL_005"]
    assert store.versions() == [1, 2]
    assert store.load().count() == 5
    old = tmp_path / "old.json"
    old.write_text(json.dumps({"counters": {"EMAIL": 12}, "values": {"EMAIL::q::x@x.it": "EMAIL_012"}}))
    other = PseudonymStore(spark, str(tmp_path / "other"))
    other.import_json(str(old))
    assert [tuple(r) for r in other.load().collect()] == [("EMAIL", "q::x@x.it", 12, "EMAIL_012")]


def test_runs_that_add_pseudonyms_at_once(spark, tmp_path, monkeypatch):
    """Another run adds a version between reading the map and claiming the next one: nothing is given twice."""
    store, other = (PseudonymStore(spark, str(tmp_path / "map")) for _ in range(2))
    order = "struct<source:string,rank:int,record:bigint,field:int,item:int,rule:int,start:int>"

    def values(*names):
        return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "value string, i bigint").select(
            F.lit("EMAIL").alias("entity_type"), "value",
            F.expr(f"cast(named_struct('a', 's', 'b', 0, 'c', i, 'd', 0, 'e', 0, 'f', 0, 'g', 0) as {order})").alias("first"), F.lit(1).alias("n"))

    store.name(values("a", "b"))
    add, turns = PseudonymStore._add, []

    def late(self, new, version, counters):
        if self is store and not turns:
            turns.append(1)
            other.name(values("c", "x", "b"))
        add(self, new, version, counters)

    monkeypatch.setattr(PseudonymStore, "_add", late)
    got = {r["value"]: r["pseudonym"] for r in store.name(values("d", "c", "a")).collect()}
    assert got == {"a": "EMAIL_001", "c": "EMAIL_003", "d": "EMAIL_005"}
    known = [tuple(r) for r in store.load().select("value", "pseudonym_no").orderBy("pseudonym_no").collect()]
    assert known == [("a", 1), ("b", 2), ("c", 3), ("x", 4), ("d", 5)] and store.versions() == [1, 2, 3]
    folders = [p for p in os.listdir(tmp_path / "map") if p.startswith("data-")]
    assert len(folders) == 3  # the one that came too late is gone
    store.compact()
    store.vacuum()
    assert len([p for p in os.listdir(tmp_path / "map") if p.startswith("data-")]) == 1
    assert [tuple(r) for r in other.load().select("value", "pseudonym_no").orderBy("pseudonym_no").collect()] == known
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: PseudonymStore(spark, str(tmp_path / "map")).name(values(f"t{k}", "shared", f"u{k}")).count(), range(4)))
    numbers = [r["pseudonym_no"] for r in store.load().collect()]
    assert sorted(numbers) == list(range(1, 15))


def test_a_run_reads_only_the_parts_it_meets(spark, tmp_path):
    store = PseudonymStore(spark, str(tmp_path / "map"))
    store.save(spark.range(1000).select(F.lit("EMAIL").alias("entity_type"), F.concat(F.lit("v"), "id").alias("value"),
                                        (F.col("id") + 1).alias("pseudonym_no"), F.concat(F.lit("EMAIL_"), "id").alias("pseudonym")))
    known = store._read(store._log()).filter(F.col("bucket").isin([3, 5]))
    assert len(known.inputFiles()) > 2 and 0 < known.count() < 100
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]")[0]


@pytest.mark.parametrize("point", ["write", "decide", "between", "end"])
def test_a_run_that_ends_leaves_the_old_or_the_new_output(spark, tmp_path, monkeypatch, point):
    path = str(tmp_path / "out")

    def save(n, sources):
        write.write_json(spark.createDataFrame([(f"f{s}", f"k{s}", n) for s in sources], "output_file string, source string, n int"), path, write.BY,
                         lambda: [f"output_file=f{s}/source=k{s}" for s in (1, 2, 3, 4)])

    def found():
        return {r["source"]: r["n"] for r in spark.read.json(path).collect()}

    save(1, [1, 2, 3])
    assert found() == {"k1": 1, "k2": 1, "k3": 1}
    with monkeypatch.context() as broken:
        if point == "write":
            broken.setattr(write.Replacement, "decide", lambda *a: 1 / 0)
        elif point == "decide":
            broken.setattr(write.Replacement, "carry_out", lambda *a: 1 / 0)
        elif point == "between":
            class Weak:
                def __init__(self, fs): self.fs, self.left = fs, 1
                def __getattr__(self, name): return getattr(self.fs, name)
                def rename(self, *a):
                    self.left -= 1
                    return self.fs.rename(*a) if self.left >= 0 else 1 / 0
            made = write.Replacement.__init__
            broken.setattr(write.Replacement, "__init__", lambda self, *a: (made(self, *a), setattr(self, "_fs", Weak(self._fs)))[0])
        if point == "end":
            save(2, [1, 2, 4])
        else:
            with pytest.raises(ZeroDivisionError):
                save(2, [1, 2, 4])
    write.recover(spark, path)
    assert found() == ({"k1": 1, "k2": 1, "k3": 1} if point == "write" else {"k1": 2, "k2": 2, "k4": 2})
    assert not [n for n in os.listdir(path) if n.startswith(("_new", "_journal"))]


def test_large_array_is_cut_into_files_that_number_on(spark, tmp_path, monkeypatch):
    """No task sorts all events: files hold a bounded number of them, and the numbers go on from file to file."""
    monkeypatch.setattr(queries, "ARRAY_EVENTS", 70)
    monkeypatch.setattr(queries, "staging_path", lambda spark, name: str(tmp_path / name))
    spark.range(0, 1000, 3).selectExpr("id as event_id", "concat('t', id % 4) as event_type", "'{\"k\": 1}' as props") \
        .repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    got = [(r["event_id"], r["record_index"]) for r in queries.json_large_array(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(3 * i, i) for i in range(334)]
    assert len(list((tmp_path / "json-array" / "one").glob("*.json"))) == 5


def test_text_files_hold_several_documents(spark, tmp_path, monkeypatch):
    """Documents come back as from files of their own, from a file per hundred of them."""
    monkeypatch.setattr(queries, "staging_path", lambda spark, name: str(tmp_path / name))
    texts = {1: "a\r\nb\r", 2: "", 3: "\n\n", 4: None, 99: "\U0001F600 x\ry\n", 100: "[]\n1", 250: "\ufeffz"}
    spark.createDataFrame([*texts.items(), (7, "c\r"), (7, "c\r")], "doc_id bigint, text string").coalesce(1) \
        .write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["content"] for r in queries.text_roundtrip(spark, str(tmp_path)).collect()}
    assert got == {1: "a\nb\n", 2: "\n", 3: "\n\n", 4: "\n", 99: "\U0001F600 x\ny\n", 100: "[]\n1\n", 7: "c\nc\n", 250: "\ufeffz\n"}
    assert len(list((tmp_path / "text").glob("part-*"))) == 3
