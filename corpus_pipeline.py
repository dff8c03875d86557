"""The corpus pipeline: quality rules, line dedup, near duplicates, source mix, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.bpe import public_vocabulary, round_trip
from cloakframe.llm.common import SPACES, cut, table, unused
from cloakframe.llm.jaccard_join import near_duplicates
from cloakframe.llm.line_dedup import dedup_lines
from cloakframe.llm.mixing import mix
from cloakframe.llm.quality import judge

# Identifiers to leave out are broadcast up to this many; beyond, they meet the documents by shuffle.
BROADCAST_IDS = 500_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive limits reject go.

    Null and empty texts fail the base rules.  Very long texts are measured
    whole; rows that repeat an identifier are judged one by one; nulls in other
    columns and columns of any name pass through; an empty table stays empty.
    """
    verdict = unused("_q", docs.columns)
    return judge(docs, verdict_col=verdict).filter(F.col(f"{verdict}.kept")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which no word is left; ``n_chars`` follows the text.

    Null texts stay null, empty and blank ones as they are.  Lines are earlier
    by identifier, then place; rows that share an identifier keep lines at the
    same place; rows without one come last.  Columns of any name pass through;
    an empty table stays empty.
    """
    lines, removed = unused("_lines", docs.columns), unused("_removed", docs.columns)
    left = dedup_lines(docs, lines_col=lines, removed_col=removed).filter((F.col(removed) == 0) | F.col("text").rlike(f"[^{SPACES}]"))
    return left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest identifier stays (with rows that repeat it).

    Null texts, empty ones and rows without an identifier are in no group and
    stay.  Very long texts are compared whole.  Columns of any name pass
    through; an empty table stays empty.
    """
    gone = cut(near_duplicates(docs).filter("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows that share an identifier as often as the most taken of them.

    A null text has size 0 and a null source is a source of its own; a null
    identifier is one like any other.  Columns of any name pass through; an
    empty table stays empty.
    """
    key, copies, copy = (unused(c, docs.columns) for c in ("_id", "_copies", "_copy"))
    taken = mix(docs).groupBy(F.col("_id").alias(key)).agg(F.max("_copies").alias(copies)).filter(F.col(copies) > 0)
    return docs.join(taken, docs.doc_id.eqNullSafe(taken[key])) \
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and whether decoding gives the text back: ``doc_id, lang, source, n_tokens, ids, restored``.

    A null text counts as empty and has no token.  Very long texts are encoded
    whole, repeated rows one by one; other columns are left out; an empty table
    stays empty.
    """
    path, pattern = public_vocabulary()
    tokens = round_trip(docs.select(
        "doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"), "text"), path, pattern)
    return tokens.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("_sha")).alias("restored"))


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
    ("source_mix", source_mix), ("bpe_round_trip", bpe_round_trip)]

# Near-duplicate groups, the fitted mix and the tokens have no SQL counterpart; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
