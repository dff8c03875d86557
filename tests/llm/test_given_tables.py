"""Registered queries and pipeline stages against brute force on the smallest given tables."""

import base64
import os
import zlib
from collections import Counter
from fractions import Fraction

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

import corpus_pipeline  # noqa: E402
from cloakframe.llm.queries import QUERIES  # noqa: E402
import brute  # noqa: E402


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall())


def rows(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, FOLDER).collect()}


@pytest.fixture(scope="module")
def reference_encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_secret_scan(spark, texts):
    for d, r in rows(spark, "op2_secret_scan").items():
        base = brute.base_secrets(texts[d] or "")
        listed = [f"{k}:{s}:{e}" for s, _, e, k in base]
        assert r["base_sha256"] == brute.sha(",".join(listed))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(
            sum(x[1] == i for x in base) for i in range(3))
        assert set(listed) <= set(r["spans"].split(",")) | ({""} if not listed else set())


def test_language_id(spark, texts):
    given = dict(duckdb.sql(f"select doc_id, lang from '{FOLDER}/documents.parquet'").fetchall())
    right = Counter()
    for d, r in rows(spark, "op3_language_id").items():
        held = zlib.crc32(str(d).encode()) % 5 == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        if held:
            right[r["lang_pred"] == given[d]] += 1
    assert right[True] >= 0.95 * right.total()


def test_bpe_round_trip(spark, texts, reference_encoding):
    for d, r in rows(spark, "op4_bpe_round_trip").items():
        ids = reference_encoding.encode_ordinary(texts[d] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), brute.sha(",".join(map(str, ids))), brute.sha(texts[d] or ""))


def test_jaccard_join(spark, texts):
    expected = brute.component_ids(texts)
    for d, r in rows(spark, "op5_jaccard_join").items():
        assert (r["n_shingles"], r["component_id"]) == (len(brute.shingles(brute.words(texts[d]))), expected[d])


def test_lm_score(spark, texts):
    expected = brute.base_scores(texts)
    for r in QUERIES["op6_lm_score"](spark, FOLDER).collect():
        n, known, total, base, held = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_source_mix(spark, texts):
    source = dict(duckdb.sql(f"select doc_id, source from '{FOLDER}/documents.parquet'").fetchall())
    size, taken, target = Counter(), Counter(), {}
    largest = Counter()
    for d, r in rows(spark, "op8_source_mix").items():
        assert r["size"] == len(brute.words(texts[d])) and r["taken"] in (0, r["size"], 2 * r["size"])
        s = source[d]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    assert sum(target.values()) == pytest.approx(1.5 * size.total())
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] and target[s] <= 2 * size[s] + 1e-6


def test_line_dedup(spark, texts):
    gone = brute.later_lines(texts)
    assert gone
    for d, r in rows(spark, "op9_line_dedup").items():
        lines = (texts[d] or "").split("\n")
        left = [x for i, x in enumerate(lines) if (d, i) not in gone]
        assert (r["n_lines"], r["n_removed"], r["text_sha256"]) == (len(lines), len(lines) - len(left), brute.sha("\n".join(left)))


def test_quality_rules(spark, texts):
    quality = dict(duckdb.sql(f"select doc_id, quality from '{FOLDER}/labels.parquet'").fetchall())
    verdicts = Counter()
    for d, r in rows(spark, "op10_quality_rules").items():
        counts = brute.quality_counts(texts[d])
        assert tuple(r)[1:6] == counts
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        if not failed and d in quality:
            verdicts[quality[d], r["kept"]] += 1
    assert verdicts[1, False] == 0 and verdicts[0, True] <= verdicts[0, False]


def test_periodic_runs(spark, texts):
    several = 0
    for d, r in rows(spark, "op11_periodic_runs").items():
        own = brute.planted_words(d, texts[d])
        found = brute.periodic_runs(own)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        several += len(found) > 1
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r["collapsed_sha256"] == brute.sha(brute.collapsed(own, found))
    assert several


def test_embedding_whitening(spark):
    given = duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet' order by vec_id").fetchall()
    x = np.floor(1024 * np.array([v for _, v in given], np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    far = x - total / n
    values, vectors = np.linalg.eigh(far.T @ far / n)
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op12_embedding_whitening"](spark, FOLDER).collect()}
    assert len(got) == 8 * n
    for k in range(1, 9):
        expected = far @ vectors[:, -k] / np.sqrt(values[-k])
        own = np.array([got[d, k]["whitened"] for d, _ in given])
        assert min(np.abs(own - expected).max(), np.abs(own + expected).max()) < 1e-8
        assert got[given[0][0], k]["explained"] == pytest.approx(values[-k] / values.sum(), rel=1e-9)
    for i, (d, _) in enumerate(given):
        r = got[d, 1]
        assert (r["n"], r["deviation"]) == (n, int(((n * x[i] - total) ** 2).sum())) and r["identity_error"] < 1e-9


def test_personal_data(spark, texts):
    for d, r in rows(spark, "op13_personal_data").items():
        base = brute.base_personal(texts[d] or "")
        listed = [f"{k}:{s}:{e}" for s, _, e, k in base]
        assert r["base_sha256"] == brute.sha(",".join(listed))
        assert tuple(r[f"n_{k}"] for k in brute.PERSONAL) == tuple(sum(x[3] == k for x in base) for k in brute.PERSONAL)
        spans = [x for x in r["spans"].split(",") if x]
        assert set(listed) <= set(spans)
        for kind, s, e in (x.split(":") for x in set(spans) - set(listed)):
            assert kind in brute.PERSONAL and not any(a < int(e) and int(s) < b for a, _, b, _ in base)


def test_pipeline_stages(spark, tmp_path, reference_encoding):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        texts = {d: r["text"] for d, r in before.items()} if name != corpus_pipeline.STAGES[-1][0] else None
        if name == "quality_rules":
            judged = {r["doc_id"] for r in QUERIES["op10_quality_rules"](spark, FOLDER).filter("kept").collect()}
            assert {r["doc_id"] for r in after} == judged
        elif name == "line_dedup":
            gone = brute.later_lines(texts)
            left = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts.items()}
            expected = {d: t for d, t in left.items() if t == texts[d] or brute.words(t)}
            assert {r["doc_id"]: r["text"] for r in after} == expected
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] != texts[r["doc_id"]])
        elif name == "jaccard_join":
            groups = brute.component_ids(texts)
            assert sorted(r["doc_id"] for r in after) == sorted(set(groups.values()))
        elif name == "source_mix":
            copies = Counter(r["doc_id"] for r in after)
            assert set(copies) <= set(texts) and max(copies.values()) <= 2
            assert sum(copies[d] * len(brute.words(t)) for d, t in texts.items()) == pytest.approx(
                1.5 * sum(len(brute.words(t)) for t in texts.values()), rel=0.1)
        else:
            mixed = {d: r["text"] for d, r in before.items()}
            assert all(r["restored"] and r["ids"] == reference_encoding.encode_ordinary(mixed[r["doc_id"]]) for r in after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).filter("not restored").count() == 0
