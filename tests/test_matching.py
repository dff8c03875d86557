"""Rules, offsets, masks and replacement against plain Python on near-miss strings."""

import random
import sys
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import plain_python as plain
from cloakframe import rules as R
from cloakframe.functions import protect
from cloakframe.functions.matching import find_all
from cloakframe.operators.detect import Detector, annotate, detect
from cloakframe.operators.records import records_from
from cloakframe.operators.sanitize import protect_hits, write_back

SEEDS = [
    "mario.rossi@example.it", "a@b.com", "é@x.fr", "x_y%z+1@sub-d.example.co", "@", "+39 3331234567", "(02) 123 4567",
    "02-1234-5678", "12345678", "0039333123456", "RSSMRA85M01H501Z", "rssmra85m01h501z", "IT60X0542811101000000123456",
    "1985-06-14", "14/6/1985", "31-12-2099", "2024-1-1", "192.168.1.42", "10.0.0.256", "192.168.100.42", "1.2.3.4.5",
    "Mario Rossi", "D'Angelo Àlvaro", "Via Roma 10", "street x, y", "٠١٢٣٤٥٦٧",
    "\U0001F600", "\U0001D400", "é", "ſ", "K", "İ", "ı", "²", "½", "_",
]
GLUE = [" ", "  ", "\n", "\r\n", "\t", "\x1c", " ", " ", ".", "-", "/", ",", ":", "", "", "é", "1", "A", "(", ")"]


def near_misses(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            word = rng.choice(SEEDS)
            if rng.random() < 0.4 and word:
                i = rng.randrange(len(word))
                word = word[:i] + rng.choice(["", rng.choice("0123456789aZ.-@/ "), word[i] * 2]) + word[i + 1:]
            parts += [word, rng.choice(GLUE)]
        out.append("".join(parts))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    values = near_misses(6000, 7) + [" ".join(SEEDS * 30)]
    frame = spark.createDataFrame(pd.DataFrame({"id": range(len(values)), "t": values})).repartition(8, "id").cache()
    return values, frame


def test_hits_equal_plain_python(texts):
    values, frame = texts
    records = records_from(frame, "s", "id", ["t"])
    got = {i: [] for i in range(len(values))}
    for r in annotate(records).select("record_index", "hits").collect():
        got[r[0]] = [(h["entity_type"], h["value"], h["char_start"], h["char_end"]) for h in r["hits"]]
    total = 0
    for i, text in enumerate(values):
        expected = plain.find(text)
        total += len(expected)
        assert got[i] == expected, repr(text)
    assert total > 5000


def test_context_rules_equal_plain_python(texts):
    values, frame = texts
    named = frame.select("id", F.col("t").alias("contact_name"), F.col("t").alias("home address"))
    got = {}
    for r in detect(records_from(named, "s", "id", ["contact_name", "home address"])).filter(
            "detector_name like '%context'").collect():
        got.setdefault((r["record_index"], r["field_path"]), []).append(
            (r["entity_type"], r["value"], r["char_start"], r["char_end"]))
    some = 0
    for i, text in enumerate(values):
        person = [h for h in plain.find(text, fits_person=True) if h[0] == "PERSON_NAME"]
        address = [h for h in plain.find(text, fits_address=True) if h[0] == "ADDRESS"]
        some += len(person) + len(address)
        assert got.get((i, "contact_name"), []) == person, repr(text)
        assert got.get((i, "home address"), []) == address, repr(text)
    assert some > 20


def test_a_very_long_name_and_address_do_not_overflow(spark):
    name = " ".join(["Mario"] * 50_000)
    frame = spark.createDataFrame([(1, name, "Via " + "x " * 100_000 + "1")], "id int, name string, address string")
    assert sorted(r["entity_type"] for r in detect(records_from(frame, "s", "id", ["name", "address"])).collect()) == [
        "ADDRESS", "PERSON_NAME"]


def test_a_text_with_thousands_of_hits(spark):
    text = "x 10.0.0.1 y a@b.it " * 5000
    frame = spark.createDataFrame([(1, text)], "id int, t string")
    found = detect(records_from(frame, "s", "id", ["t"])).orderBy("rule_rank", "char_start").collect()
    assert [(r["entity_type"], r["value"], r["char_start"], r["char_end"]) for r in found] == plain.find(text)


def test_masks_equal_plain_python(texts):
    values, frame = texts
    kinds = list(R.ENTITY_TYPES)
    got = frame.select("id", *[protect.mask_value(F.col("t"), F.lit(k)).alias(k) for k in kinds]).collect()
    for r in got:
        for k in kinds:
            assert r[k] == plain.mask(values[r["id"]], k), (k, repr(values[r["id"]]))


def test_sanitizing_equals_plain_python(texts):
    values, frame = texts
    records = annotate(records_from(frame, "s", "id", ["t"]))
    for mode, change in (("mask", plain.mask), ("redact", lambda v, k: f"[REDACTED_{k}]")):
        for r in write_back(protect_hits(records, mode)).select("record_index", "content.t").collect():
            text = values[r[0]]
            assert r["t"] == plain.sanitize(text, plain.find(text), change), repr(text)


def test_character_classes_match_python(spark):
    """Every assigned code point both Unicode versions know, on all class boundaries."""
    import unicodedata

    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    frame = spark.createDataFrame(pd.DataFrame({"c": [chr(c) for c in points]})).repartition(8)
    letter = r"[A-Za-zİıſK]"
    rows = frame.select(
        "c", F.col("c").rlike(r"[\p{L}\p{N}_]").alias("word"), F.col("c").rlike(r"\p{Nd}").alias("digit"),
        F.col("c").rlike(r"[\p{IsWhite_Space}\x1C-\x1F]").alias("space"), F.col("c").rlike(letter).alias("caseless"),
        F.col("c").rlike(protect._DIGIT).alias("isdigit"), F.col("c").rlike(r"\P{Cn}").alias("known")).toPandas()
    rows = rows[rows["known"]]
    import re
    python = {"word": r"\w", "digit": r"\d", "space": r"\s", "caseless": r"(?i)[A-Z]"}
    tests = {name: (lambda c, p=re.compile(p): p.match(c) is not None) for name, p in python.items()}
    tests["isdigit"] = str.isdigit
    for name, is_one in tests.items():
        differ = rows[rows[name] != rows["c"].map(is_one)]
        assert differ.empty, (name, [hex(ord(c)) for c in differ["c"]])


def test_typed_values_equal_their_text(spark):
    """Integers, dates and timestamps are decided without a search; their text gives the same hits."""
    frame = spark.sql("""
        select id, cast(x as bigint) as n, cast(x % 2000000000 as int) as i,
               timestamp_ntz'1899-12-30 23:59:58' + make_dt_interval(d, 1, 0, s) as ts,
               cast(timestamp'1899-12-30 00:00:00' + make_dt_interval(d * 3, 0, 0, s) as timestamp) as tz,
               date_add(date'1880-01-01', d) as dt
        from (select id, if(id % 2 = 0, 1, -1) * cast(pow(10, id % 15) as bigint) * (1 + id % 9) - id % 3 as x,
                     cast(id * 37 % 90000 as int) as d, cast(id % 4 / 16.0 as decimal(8, 6)) as s from range(4000))""")
    columns = ["n", "i", "ts", "tz", "dt"]
    as_text = frame.select("id", *[F.col(c).cast("string").alias(c) for c in ("n", "i", "dt")], *[
        F.when(F.contains(F.col(c).cast("string"), F.lit(".")), F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .otherwise(F.col(c).cast("string")).alias(c) for c in ("ts", "tz")]).select("id", *columns)
    fields = ["record_index", "field_path", "entity_type", "value", "char_start", "char_end"]
    typed = detect(records_from(frame, "s", "id", columns)).select(*fields)
    texts = detect(records_from(as_text, "s", "id", columns)).select(*fields)
    assert typed.count() > 5000
    assert sorted(map(tuple, typed.collect())) == sorted(map(tuple, texts.collect()))


def test_doubles_are_scanned_as_python_prints_them(spark):
    values = [12345678.0, 1e7, 123456789012.5, 1.5, 0.00012345678, 12.3456789, -87654321.25, 1e15, 9.9e15, 3.0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    got = {}
    for r in detect(records_from(frame, "s", "id", ["v"])).collect():
        got.setdefault(r["record_index"], []).append((r["entity_type"], r["value"], r["char_start"], r["char_end"]))
    assert got == {i: plain.find(str(v)) for i, v in enumerate(values) if plain.find(str(v))}


def test_custom_rules(spark):
    frame = spark.createDataFrame([(1, "Alias OPERATORE ALFA per test locale", True)], "id int, notes string, ok boolean")
    found = detect(records_from(frame, "s", "id", ["notes", "ok"]), Detector(
        spark, {"PERSON_NAME": r"OPERATORE\s+ALFA", "ADDRESS": r"(?P<a>T)rue\Z"})).collect()
    assert [(r["entity_type"], r["value"], r["detector_name"], r["confidence"]) for r in found] == [
        ("PERSON_NAME", "OPERATORE ALFA", "custom-person_name-regex", 0.8),
        ("ADDRESS", "True", "custom-address-regex", 0.8)]
    for bad in ({"NOPE": "x"}, {"EMAIL": "("}, {"EMAIL": "x*"}):
        with pytest.raises(ValueError):
            Detector(spark, bad)


def test_email_search_is_linear_on_long_runs(spark):
    """Ten megabytes without an address start, and addresses at the edges of long runs."""
    import time

    from pyspark.sql import functions as F

    from cloakframe.operators.detect import Detector, detect
    from cloakframe.operators.records import texts_from

    run = "aB3+" * 100
    texts = [f"{run}@", f"{run}@x.it", f"é{run}@x.it", f"{run}@bad@x.it", f"x@y.it {run} z@y.it", f"{run}%q@x", f"é{'a' * 400}@x.it"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    email = Detector(entities=["EMAIL"])
    got = {(r["source_id"], r["value"], r["char_start"]) for r in detect(texts_from(frame, F.col("i"), "t"), email).collect()}
    assert got == {(str(i), h[1], h[2]) for i, t in enumerate(texts) for h in plain.find(t) if h[0] == "EMAIL"}
    start = time.perf_counter()
    long = spark.createDataFrame([("aB3+" * 2_500_000 + " end@x.it",)], "t string")
    assert detect(texts_from(long, F.lit("s"), "t"), email).count() == 1
    assert time.perf_counter() - start < 60


def test_very_many_matches_in_one_text(spark):
    """Offsets are running sums; an array that is copied for every number made this quadratic (minutes)."""
    n = 100_000
    values = [f"u{i}@x.it" for i in range(n)]
    starts = [0]
    for v in values:
        starts.append(starts[-1] + len(v) + 1)
    row = spark.createDataFrame([(" ".join(values),)], "t string")
    began = time.monotonic()
    got = row.select(find_all("t", r"u\d+@x\.it").alias("h")).select("h.value", "h.char_start").first()
    assert time.monotonic() - began < 25
    assert got["value"] == values and got["char_start"] == starts[:-1]
