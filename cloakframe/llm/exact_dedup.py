"""Exact duplicates by a distributed sort of the content.

Sampled splitters range-partition the rows by a short form of the content
(its first characters and a hash), each partition is sorted externally, which
puts equal texts next to each other, and neighbours are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hot_slots, partitions, table

# Splitters hold this much of a text; the rest is compared between neighbours only.
HEAD = 32


def exact_groups(docs: DataFrame, text: Column, id_col: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """Groups of equal texts: ``id_col, keep_id, group_size, kept, text_sha256``, one row per input row.

    ``text`` is the normalised content (null counts as empty); ``keep`` names
    which identifier of a group stays.  Rows that repeat an identifier stay or
    go together.  A null identifier stays only if its group has no other.
    An empty table gives an empty result; other columns are ignored.

    Only the short sort key is sampled, so the driver sees no texts.  A text
    with more copies than half a partition's share is spread over several
    runs; runs are compared inside as all others, and the few of the same
    content (at most a number fixed by the partition count) are joined by
    their SHA-256.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text, F.lit("")).alias("_t"))
    hashed = F.xxhash64("_t")
    hot = hot_slots(rows, hashed, n)
    placed = (
        rows.withColumn("_key", hashed).join(F.broadcast(hot), "_key", "left")
        .withColumn("_run", F.when(F.col("_slots").isNotNull(), F.pmod(F.xxhash64("_id"), F.col("_slots"))))
        .withColumn("_head", F.substring("_t", 1, HEAD))
        .repartitionByRange(n, "_head", "_key", "_run")
    )
    # The range partitioning already places the rows of a run together: no further exchange.
    equal = Window.partitionBy("_head", "_key", "_run", "_t")
    runs = cut(placed.select(
        "_id", "_run", F.sha2("_t", 256).alias("text_sha256"),
        best("_id").over(equal).alias("_best"), F.count(F.lit(1)).over(equal).alias("_n")), "exact-runs")
    # One row per run: the splits of a frequent text are few, so this table is small.
    split = (
        runs.filter(F.col("_run").isNotNull())
        .groupBy("text_sha256", "_run").agg(F.first("_best").alias("_best"), F.first("_n").alias("_n"))
        .groupBy("text_sha256").agg(best("_best").alias("_whole_best"), F.sum("_n").alias("_whole_n"))
    )
    keep_id = F.coalesce("_whole_best", "_best")
    return runs.join(F.broadcast(split), "text_sha256", "left").select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"),
        F.coalesce("_whole_n", "_n").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their group of equal texts; the largest doc_id of a group stays."""
    return exact_groups(table(spark, folder, "documents"), F.col("text"), keep="largest")


OP1_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
