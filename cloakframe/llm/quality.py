"""Quality rules whose limits adapt to the documents of each language and source.

Measures are SQL expressions per text.  Their distributions are kept as
fixed-resolution histograms per language and source: sketches that merge by
adding counts, so any order of merging gives the same quantiles.  Limits come
from the quartiles and are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, table, text_of, unused

# --- fixed values of the base rules -------------------------------------------
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
SYMBOLS = "[#*$%&|<>]"
# --------------------------------------------------------------------------------

# Measures in thousandths: (name, least spread, sides).  A document is rejected when a measure lies further than
# SPREADS times the interquartile range (or the least spread, if larger) from the quartile on that side.
MEASURES = (
    ("symbols", 10, "upper"), ("capitals", 30, "upper"), ("marks", 30, "upper"),
    ("stutter", 30, "upper"), ("duplicate_lines", 150, "upper"), ("word_length", 600, "both"))
SPREADS = 4
# Values from EXACT on share a bucket with those less than a thousandth larger, so a sketch has no top.
EXACT = 1_000
# The quartiles of a group are blended with those of the group above as if that lent it this many documents.
LENT = 200
GROUP = ("lang", "source")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_row`` (all columns of ``docs``) and ``_q`` (counts and measures); one projection, nothing is shuffled.

    A null text counts as empty.  Windows are compared by a 64-bit hash.
    """
    t = text_of(f"_row.{text_col}")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row")).withColumn("_w", _words(t))
    held = held.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    held = held.withColumn("_win", F.when(F.size("_h") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("_h") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a repeated window sort theirs: equal windows become neighbours.
    held = held.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_win")) < F.size("_win"),
        F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    held = held.withColumn("_at", F.array_sort(F.filter(F.transform("_sorted", lambda p, k: F.when(
        (p["x"] == F.get("_sorted", k - 1)["x"]) | (p["x"] == F.get("_sorted", k + 1)["x"]), p["i"])),
        lambda i: i.isNotNull())))
    repeated = F.aggregate("_at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
                           lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n")))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACES}]"))
    held = held.withColumn("_c", F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated["n"], F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter("_h", lambda x, i: x == F.get("_h", i + 1))).cast("long").alias("n_stutter"),
        F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_capitals"),
        F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("n_marks")))
    c = {name: F.col(f"_c.{name}") for name in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_capitals", "n_marks")}

    def share(part: Column, whole: Column, name: str) -> Column:
        return F.floor(part * 1000 / F.greatest(whole, F.lit(1))).cast("bigint").alias(name)

    return held.withColumn("_q", F.struct(
        *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])).alias("base_failed"),
        share(c["n_symbols"], c["word_chars"], "symbols"), share(c["n_capitals"], c["word_chars"], "capitals"),
        share(c["n_marks"], c["word_chars"], "marks"), share(c["n_stutter"], c["n_words"], "stutter"),
        share(c["n_dup_lines"], c["n_lines"], "duplicate_lines"),
        share(c["word_chars"], c["n_words"], "word_length"))).drop("_w", "_h", "_win", "_sorted", "_at", "_c")


def bucket(value: Column) -> Column:
    """Number of the bucket of a measure."""
    return F.when(value < EXACT, value).otherwise(EXACT + F.floor(F.log(value / EXACT) * EXACT)).cast("int")


def bucket_value(number: Column) -> Column:
    """Least value of a bucket."""
    return F.when(number < EXACT, number.cast("double")).otherwise(EXACT * F.exp((number - EXACT) / EXACT))


def histograms(measures: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """The sketches: ``group, measure, bucket, n``.  Counts are combined before the shuffle.

    Documents that fail the base rules have no say in what is usual.
    """
    names = [m[0] for m in MEASURES]
    return (
        measures.filter(~F.col("_q.base_failed"))
        .select(*[F.col(f"_row.{g}").alias(g) for g in group], F.explode(F.array(*[F.struct(
            F.lit(i).alias("measure"), bucket(F.col(f"_q.{m}")).alias("bucket")) for i, m in enumerate(names)])).alias("m"))
        .groupBy(*group, "m.measure", "m.bucket").agg(F.count("*").alias("n"))
    )


def limits(sketches: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Accepted range of each measure per group: ``group, total, ranges`` (``array<struct<low, high>>``).

    A group's quartiles are blended with those of the group above, of its
    language and then of all documents, in proportion to its own documents and
    ``LENT`` more: a group's limits change little by little as it grows.
    Windows run over the buckets of one sketch, never over documents.
    """
    levels = [group[:k] for k in range(len(group), -1, -1)]
    quartiles = None
    known = sketches.select(*group).distinct()
    for depth, keys in enumerate(levels):
        merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(*keys, "measure")
        ranked = merged.withColumn("total", F.sum("n").over(whole)).withColumn(
            "below", F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        one = ranked.groupBy(*keys, "measure").agg(
            F.first("total").alias("total"),
            F.min(F.when(F.col("below") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
            F.min(F.when(F.col("below") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"))
        packed = one.groupBy(*keys).agg(F.first("total").alias(f"_t{depth}"), F.array_sort(F.collect_list(
            F.struct("measure", bucket_value(F.col("q1")).alias("q1"), bucket_value(F.col("q3")).alias("q3")))).alias(f"_r{depth}"))  # one entry per measure
        if keys:
            same = F.lit(True)
            for k in keys:
                same = same & known[k].eqNullSafe(packed[k])
            known = known.join(packed, same, "left").select(known["*"], f"_t{depth}", f"_r{depth}")
        else:
            known = known.join(F.broadcast(packed), F.lit(True), "left")  # a single row
    last = len(levels) - 1

    def blended(depth: int) -> Column:
        if depth == last:
            return F.col(f"_r{last}")
        own = F.col(f"_t{depth}") / (F.col(f"_t{depth}") + LENT)
        return F.zip_with(f"_r{depth}", blended(depth + 1), lambda r, above: F.struct(
            r["measure"].alias("measure"), *[(own * r[q] + (1 - own) * above[q]).alias(q) for q in ("q1", "q3")]))

    chosen = blended(0)
    spread = F.array(*[F.lit(m[1]) for m in MEASURES])
    both = F.array(*[F.lit(m[2] == "both") for m in MEASURES])
    return known.select(*group, F.transform(chosen, lambda r: F.struct(
        F.when(F.get(both, r["measure"]), r["q1"] - SPREADS * F.greatest(r["q3"] - r["q1"], F.get(spread, r["measure"])))
        .otherwise(-1).alias("low"),
        (r["q3"] + SPREADS * F.greatest(r["q3"] - r["q1"], F.get(spread, r["measure"]))).alias("high"))).alias("_ranges"))


def judge(docs: DataFrame, text_col: str = "text", group: tuple[str, ...] = GROUP, verdict_col: str = "_q") -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept`` in the struct column ``verdict_col``.

    The measured rows are written once to the shared folder, so texts are
    searched once.  Null languages or sources are groups of their own; rows
    that repeat an identifier are judged one by one; an empty table gives an
    empty result; ``verdict_col`` gets underscores added where ``docs`` has a
    column of that name, which stays as it is.  Empty and very long texts are
    measured like any other.
    """
    held = cut(measured(docs, text_col), "quality")
    accepted = cut(limits(histograms(held, group), group), "quality-limits")
    # One row per language and source: the planner broadcasts it when its size allows and splits hot groups otherwise.
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"_row.{g}").eqNullSafe(accepted[g])
    measures = F.array(*[F.col(f"_q.{m[0]}") for m in MEASURES])
    fits = F.coalesce(F.forall(F.arrays_zip(measures.alias("v"), F.col("_ranges").alias("r")), lambda x: (
        x["v"] >= x["r"]["low"]) & (x["v"] <= x["r"]["high"])), F.lit(True))
    return held.join(accepted, same, "left").select(
        *[F.col(f"_row.`{c}`") for c in docs.columns],
        F.col("_q").withField("kept", ~F.col("_q.base_failed") & fits).alias(unused(verdict_col, docs.columns)))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and verdict of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    judged = judge(docs)
    return judged.select("doc_id", *[f"_q.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
