"""Mixing sources to target weights by entropy balancing.

Every source gets a token target.  Document rates are the closest to taking
each document once (binary entropy between none and twice) that meet it:
``rate = 2 / (1 + exp(-lambda * size))`` with one multiplier per source, found
by Newton steps on the convex dual.  Each step is one aggregate over the
(source, size) counts.  Rates become whole copies by systematic rounding, with
running sums taken in two levels so no source lands in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, cut, raw_bytes, table, words

# --- fixed values of the contract ---------------------------------------------
WEIGHTS = (3, 1, 2)  # by source in code point order, null last, repeating
SHARE = 1.5          # of all words
MOST = 2.0           # times a source's or a document's size
# --------------------------------------------------------------------------------
STEPS = 40
CLOSE = 1e-9
# Rows of one size in one source are numbered in slices of about this many.
SLICE = 50_000


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``_id, _source, _size``: the words of each text (null: 0)."""
    def count(batches):
        for batch in batches:
            for part in blocks(batch, "_t"):
                _, starts = words(*raw_bytes(part.column("_t")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_source"), pa.array(np.diff(starts), pa.int64())],
                    ["_id", "_source", "_size"])

    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
                       F.col(text_col).alias("_t")) \
        .mapInArrow(count, f"_id {docs.schema[id_col].dataType.simpleString()}, _source string, _size bigint")


def targets(by_source: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Token target of each source: shares by weight, none above ``most`` times its size, the excess shared anew."""
    order = sorted(by_source, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, free, out = share * sum(size.values()), set(size), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > most * size[s]}
        if not full:
            out |= {s: weight[s] * unit for s in free}
            break
        out |= {s: most * size[s] for s in full}
        left -= sum(most * size[s] for s in full)
        free -= full
    return out


def _sigmoid(x):
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def multipliers(counts: DataFrame, target: dict, size: dict, most: float = MOST) -> dict:
    """One multiplier per source by guarded Newton steps; the driver holds one number per source.

    ``None`` stands for a target that needs every document at its most.
    """
    spark = counts.sparkSession
    mean = {r["_source"]: r["m"] for r in counts.groupBy("_source").agg(
        (F.sum(F.col("_size") * F.col("_n")) / F.sum("_n")).alias("m")).collect()}
    found: dict = {}
    state = {}
    for s in target:
        if target[s] >= most * size[s] * (1 - 1e-12):
            found[s] = None
        else:
            state[s] = [0.0, -math.inf, math.inf]
    for _ in range(STEPS):
        if not state:
            break
        now = spark.createDataFrame([(s, v[0], 1.0 / mean[s]) for s, v in state.items()], "_s string, _l double, _u double")
        x = F.col("_size") * F.col("_u")
        rate = _sigmoid(F.col("_l") * x)
        rows = counts.join(F.broadcast(now), F.col("_source").eqNullSafe(F.col("_s"))).groupBy("_source").agg(
            F.sum(F.col("_n") * F.col("_size") * rate * most).alias("taken"),
            F.sum(F.col("_n") * F.col("_size") * x * rate * (1 - rate) * most).alias("slope")).collect()
        for r in rows:
            s = r["_source"]
            at, low, high = state[s]
            miss = r["taken"] - target[s]
            if abs(miss) <= CLOSE * max(1.0, target[s]):
                found[s] = at / mean[s]
                del state[s]
                continue
            low, high = (low, at) if miss > 0 else (at, high)
            step = at - miss / r["slope"] if r["slope"] > 0 else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else (2 * at - 1 if miss > 0 else 2 * at + 1)
            state[s] = [step, low, high]
    return found | {s: v[0] / mean[s] for s, v in state.items()}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """How often each document is taken: ``_id, _source, _size, _copies, source_size, target``.

    A null source is a source of its own; a null or empty text has size 0 and
    is taken as often as its rate says (it costs nothing).  Documents of equal
    size are told apart by identifier; rows that repeat an identifier are
    counted one by one.  An empty table gives an empty result.  The number of
    sources is assumed to fit the driver (one number each).
    """
    spark = docs.sparkSession
    sized = cut(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    counts = cut(sized.groupBy("_source", "_size").agg(F.count("*").alias("_n")), "mix-counts")
    size = {r["_source"]: r["s"] for r in counts.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("s")).collect()}
    target = targets(list(size.items()), weights, share, most)
    found = multipliers(counts, target, size, most)
    per_source = spark.createDataFrame(
        [(s, size[s], float(target[s]), found[s]) for s in size],
        "_s string, source_size bigint, target double, _l double")
    same = F.col("_source").eqNullSafe(F.col("_s"))
    rate = F.when(F.col("_l").isNull(), F.lit(most)).otherwise(_sigmoid(F.col("_l") * F.col("_size")) * most)
    # Running sum of rates before each size, large documents first, so the error ends at the small ones.
    before = Window.partitionBy("_source").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    by_size = counts.join(F.broadcast(per_source), same).withColumn("_rate", rate).withColumn(
        "_sum", F.coalesce(F.sum(F.col("_n") * F.col("_rate")).over(before), F.lit(0.0))) \
        .select("_source", "_size", "_rate", "_sum", "source_size", "target")
    # Then the place of each document among those of its size, first by slice and then inside the slice.
    share = counts.select(F.col("_source").alias("_s3"), F.col("_size").alias("_z3"), F.ceil(F.col("_n") / SLICE).alias("_slices"))
    sliced = sized.join(share, F.col("_source").eqNullSafe(F.col("_s3")) & (F.col("_size") == F.col("_z3"))).select(
        "_id", "_source", "_size", F.pmod(F.xxhash64("_id"), F.col("_slices")).cast("int").alias("_slice"))
    earlier = Window.partitionBy("_source", "_size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy("_source", "_size", "_slice").agg(F.count("*").alias("_n")).withColumn(
        "_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0))) \
        .join(by_size.withColumnsRenamed({"_source": "_s2", "_size": "_z2"}),
              F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_size") == F.col("_z2"))) \
        .select(F.col("_source").alias("_s1"), F.col("_size").alias("_z1"), F.col("_slice").alias("_l1"),
                "_skip", "_rate", "_sum", "source_size", "target")
    place = Window.partitionBy("_source", "_size", "_slice").orderBy("_id")
    numbered = sliced.withColumn("_row", F.row_number().over(place)).join(
        slices, F.col("_source").eqNullSafe(F.col("_s1")) & (F.col("_size") == F.col("_z1")) & (F.col("_slice") == F.col("_l1")))
    reached = F.col("_sum") + (F.col("_skip") + F.col("_row")) * F.col("_rate")
    copies = F.least(F.floor(reached + 0.5) - F.floor(reached - F.col("_rate") + 0.5), F.lit(int(most)))
    return numbered.select("_id", "_source", "_size", copies.cast("int").alias("_copies"), "source_size", "target")


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken from every document so that sources meet their weights."""
    return mix(table(spark, folder, "documents")).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_copies") * F.col("_size")).alias("taken"))
