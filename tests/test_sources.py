"""Large files read in splits, headers, odd JSON values and nested variants, against plain Python."""

import csv
import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.cells import variant_cells
from cloakframe.operators.records import index_records
from cloakframe.shared import cut
from cloakframe.sources import csv as csv_source
from cloakframe.sources import json as json_source
from cloakframe.sources.json_blocks import depths, structure
from cloakframe.sources.query import key_bounds, key_ranges, load_query

NEVER = 1 << 40


@contextmanager
def splits(spark, size):
    """Files are cut into splits of ``size`` bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(frame, *columns):
    found = index_records(cut(frame)).select("source_id", "record_index", *columns).collect()
    return sorted(((r[0].rsplit("/", 1)[-1], *r[1:]) for r in found), key=lambda r: (r[0], -1 if r[1] is None else r[1]))


def random_value(chance, depth=0):
    kind = chance.randrange(9)
    if kind == 0 and depth < 3:
        return [random_value(chance, depth + 1) for _ in range(chance.randrange(3))]
    if kind <= 3 and depth < 3:
        return {chance.choice(["a", "b", "records", "}", '"q\\']): random_value(chance, depth + 1) for _ in range(chance.randrange(4))}
    if kind == 4:
        return chance.choice(["}", "{[", "\\", '\\"', '"records":[', "a,b\n", "é😀", "\\\\}"]) * chance.randrange(60)
    return chance.choice([1, 2.5, None, True, "text"])


@pytest.mark.parametrize("seed", [1, 2])
def test_large_json_documents_are_read_in_splits(spark, tmp_path, seed):
    chance = random.Random(seed)
    documents = {f"list{i}": [random_value(chance) for _ in range(chance.randrange(80))] for i in range(4)}
    documents |= {
        "empty": [], "object": {f"k{i}": random_value(chance) for i in range(40)}, "text": "x}" * 400,
        "wrapped": {"x": random_value(chance), "records": [random_value(chance) for _ in range(60)], "other": [{"a": [1, 2]}, 3] * 30},
        "inner": {"other": {"records": [1, 2, 3]}, "y": ["z"] * 50, "records": []}}
    expected = []
    for name, value in documents.items():
        text = json.dumps(value, indent=chance.choice([None, 2]), ensure_ascii=False)
        (tmp_path / f"{name}.json").write_text(("﻿" if name == "list1" else "") + text + chance.choice(["", "\n"]), "utf-8")
        value = value["records"] if isinstance(value, dict) and "records" in value else value
        expected += [(f"{name}.json", i, v) for i, v in (enumerate(value) if isinstance(value, list) else [(None, value)])]
    lines = [{"a": "}" * (i % 7), "i": i} for i in range(90)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
    expected += [("lines.json", i, v) for i, v in enumerate(lines)]
    with splits(spark, 300):
        got = rows(json_source.load_json_text(spark, str(tmp_path), large=200), "content")
        whole = rows(json_source.load_json_text(spark, str(tmp_path), large=NEVER), "content")
    assert got == whole
    assert [(s, i, json.loads(c)) for s, i, c in got] == sorted(
        ((s, i, v if isinstance(v, dict) else {"value": v}) for s, i, v in expected), key=lambda r: (r[0], -1 if r[1] is None else r[1]))


@pytest.mark.parametrize("text", ['[{"a":1},{"b":2}', '[{"a":1},{"b":2}] x', '{"records":[{"a":1}', '[{"a":1},,{"b":2}]', '[{"a":"x}]'])
def test_broken_large_json_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text + " " * 400)
    with splits(spark, 100), pytest.raises(Exception, match="JSON|Expecting|Extra data|Unterminated"):
        json_source.load_json_text(spark, str(tmp_path), large=10).collect()


def test_structure_of_json_bytes():
    own, odd = structure(rb'{"a\"}":["]",1]}')
    outside = ~odd
    assert [i for i, c in enumerate(own) if outside[i] and c in b"{}[]"] == [0, 8, 14, 15] and depths(own, outside)[-1] == 0


def test_numbers_and_characters_json_cannot_write(spark, tmp_path):
    """NaN and infinities become texts, half a character the replacement character."""
    (tmp_path / "x.json").write_text(r'[{"a":NaN,"b":[1,-Infinity]},{"a":"\ud800x 😀"},{"a":2.5}, Infinity]')
    got = rows(json_source.load_json(spark, str(tmp_path)), "content")
    assert [r[2].asDict() for r in got] == [
        {"a": "NaN", "b": ["1", "-Infinity"], "value": None}, {"a": "�x 😀", "b": None, "value": None},
        {"a": "2.5", "b": None, "value": None}, {"a": None, "b": None, "value": "Infinity"}]
    cells = variant_cells(json_source.variant_records(json_source.load_json_text(spark, str(tmp_path))))
    assert sorted(r["value"] for r in cells.filter("record_index = 0").collect()) == ["-Infinity", "1", "NaN"]


def test_variants_of_any_shape(spark):
    chance = random.Random(3)
    documents = ['{"v":[{"a":[1]},5]}', '{"a":' * 40 + '"deep"' + "}" * 40, "[]", "{}", "7", '[[[]],{"x":{}},["<",">"]]']
    documents += [json.dumps(random_value(chance)) for _ in range(60)]

    def walk(value, path=""):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, f"{path}[{i}]")
        elif value is not None:
            yield path or "<root>", "True" if value is True else "False" if value is False else str(value)

    frame = spark.createDataFrame(list(enumerate(documents)), "record_index bigint, doc string").select(
        F.lit("t").alias("source_id"), "record_index", F.parse_json("doc").alias("content"))
    got = sorted((r["record_index"], r["field_path"], r["value"]) for r in variant_cells(frame).collect())
    assert got == sorted((i, p, v) for i, d in enumerate(documents) for p, v in walk(json.loads(d)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_large_csv_files_are_read_in_splits(spark, tmp_path, seed):
    chance = random.Random(seed)
    expected = []
    for k in range(6):
        values = ["a", "", "b c", "x,y", 'say "hi"', '"', '5" pipe', "é😀"] + (["l1\nl2", "\n", '"\n"', "l\n" * 90] if k % 2 else [])
        path = tmp_path / f"f{k}.csv"
        with open(path, "w", newline="", encoding="utf-8-sig" if k == 3 else "utf-8") as out:
            writer = csv.writer(out, lineterminator=chance.choice(["\n", "\r\n"]), quoting=chance.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
            writer.writerow(["id", "x", "y"])
            for i in range(40):
                writer.writerow([i, chance.choice(values), chance.choice(values)][:chance.choice([2, 3, 3])])
            out.write("\n" * (k % 3))
        with open(path, newline="", encoding="utf-8-sig") as given:
            expected += [(f"f{k}.csv", i, *((r[c] or "").replace("\r\n", "\n") for c in ("id", "x", "y"))) for i, r in enumerate(csv.DictReader(given))]
    with splits(spark, 300):
        got = rows(csv_source.load_csv(spark, str(tmp_path), large=100), "content.*")
        whole = rows(csv_source.load_csv(spark, str(tmp_path), large=NEVER), "content.*")
    assert got == whole == expected


def test_odd_quotes_and_blank_lines_in_splits(spark, tmp_path):
    text = 'id,x\n1,mid"quote\n   \n2,"a\nb"\n3,"open"y\n4,5\n' + "6,7\n" * 60
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("id,x\n" + "1,2\n \n" * 60)
    with splits(spark, 80):
        got = rows(csv_source.load_csv(spark, str(tmp_path), large=50), "content.*")
        whole = rows(csv_source.load_csv(spark, str(tmp_path), large=NEVER), "content.*")
    assert got == whole


@pytest.mark.parametrize("text", ["", 'a"b', 'x,"', '"a","b', '"a""', '"a"b,"', '"",""', 'a,"b"",c'])
def test_open_quotes(text):
    """Whether the text ends inside a quoted value: then a line end does not end the record."""
    assert csv_source.still_open(text) == (len(list(csv.reader([text + "\n", "x\n"]))) == 1)


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,x\n1,2\n", "utf-8")
    (tmp_path / "b.csv").write_text("\n \nid,x\r\n" + "1,2\n" * 100)
    (tmp_path / "c.csv").write_text('id,"two\nlines"\n1,2\n')
    (tmp_path / "d.CSV").write_text("other")
    (tmp_path / "e.csv").write_text("")
    got = [(n, [i.rsplit("/", 1)[-1] for i in ids]) for n, ids in csv_source.headers(spark, str(tmp_path))]
    assert got == [(["id", "two\nlines"], ["c.csv"]), (["id", "x"], ["a.csv", "b.csv"]), (["other"], ["d.CSV"])]
    with pytest.raises(ValueError, match="different headers"):
        csv_source.load_csv(spark, str(tmp_path))


def test_query_rows_have_equal_numbers_for_any_number_of_parts(spark):
    spark.range(500).selectExpr("if(id % 11 = 0, null, id * 7919 % 61) as k", "id", "cast(id as string) as t").createOrReplaceTempView("numbered")
    got = []
    for parts in (1, 3, 16):
        frame = index_records(cut(load_query(spark, "select * from numbered", split_by="k", parts=parts)))
        got.append({r["id"]: r["record_index"] for r in frame.select("content.id", "record_index").collect()})
    assert got[0] == got[1] == got[2] and sorted(got[0].values()) == list(range(500))
    assert max(got[0][i] for i in range(500) if i % 11) < min(got[0][i] for i in range(0, 500, 11))


def test_key_ranges_part_all_rows(spark):
    rows = spark.sql("select if(id % 9 = 0, null, cast(id % 40 as string)) as k, id from range(300)")
    for kind in ("string", "int", "date"):
        keys = rows.select((F.date_add(F.lit("2024-01-01"), F.col("k").cast("int")) if kind == "date" else F.col("k").cast(kind)).alias("k"))
        bounds = key_bounds(keys, 6)
        assert 3 <= len(bounds) <= 5
        conditions = [c.replace("{d ", "date ").replace("}", "") for c in key_ranges("k", bounds)]
        counts = [keys.filter(c).count() for c in conditions]
        assert sum(counts) == 300 and max(counts) < 120
    assert key_ranges("k", ["o'x"]) == ["k < 'o''x'", "k >= 'o''x'", "k IS NULL"]
