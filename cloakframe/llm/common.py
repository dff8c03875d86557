"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, delete_path, shared_dir, ship

# White space between words: the space and the characters 9 to 13.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
# Texts are taken through numpy in blocks of about this many bytes, so the working arrays stay small.
BLOCK = 1 << 20
# Running sums over the bytes of a block are taken in strides that stay in the processor's cache.
STRIDE = 1 << 16

__all__ = ["BLOCK", "SPACES", "WORD", "Words", "blocks", "cut", "drop", "hot_slots", "partitions", "raw_bytes", "shingles", "ship", "shuffles_removed", "table", "text_of", "unused", "words"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(name: str, taken: Iterable[str]) -> str:
    """A column name like ``name`` that is not among ``taken``, whatever the case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop(df: DataFrame) -> None:
    """Remove the written tables (see ``cut``) that ``df`` reads; what follows reads others."""
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/").rsplit("/", 1)[-1]
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if path.rsplit("/", 2)[1] == root:  # a folder right below the shared one
            delete_path(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of every query that ends inside the block are removed then, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def hot_slots(df: DataFrame, key: Column, slots: int) -> DataFrame:
    """Keys that hold more rows than half an even share, and over how many slots to spread each.

    At most ``2 * slots`` keys can be that frequent, so the result has a size
    bound that does not depend on the data and may be broadcast.  Columns:
    ``_key``, ``_slots``.
    """
    counts = df.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
    total = df.count()
    least = max(1, total // (2 * slots))
    hot = counts.filter(F.col("_n") > least).select(
        "_key", F.ceil(F.col("_n") / least).cast("int").alias("_slots")).collect()
    return df.sparkSession.createDataFrame([tuple(r) for r in hot], counts.select(
        "_key", F.lit(1).alias("_slots")).schema)


# --- words and shingles as 64-bit hashes --------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a finaliser of shifts and odd factors)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_values(lower: bool) -> np.ndarray:
    values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if lower:
        values[65:91] = values[97:123]
    values[_IS_SPACE] = 0
    return values


_BYTES = {True: _byte_values(True), False: _byte_values(False)}
# Odd factors for places and their inverses: a word's hash is a sum over its bytes, taken as a
# difference of running sums and shifted to the start of the word.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; kept for the usual block size."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, _UNBASE):
        row = np.full(max(n, 2 * STRIDE), base)
        row[0] = 1
        made.append(np.multiply.accumulate(row))
    if n <= 2 * STRIDE:
        _POWERS[:] = made
    return made[0], made[1]


Words = tuple[np.ndarray, np.ndarray]


def raw_bytes(texts: pa.Array) -> Words:
    """Bytes of all texts one after another, and where each text starts (one more entry for the end)."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def words(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> Words:
    """One 64-bit hash per word of the texts, and where each text's words start."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[(ends > 0) & (ends < len(data))]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, ends)
    hashes = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(starts, starts[at] + STRIDE)))
        end = starts[last] if last < len(starts) else len(data)
        own = starts[at:last] - starts[at]
        size = int(end - starts[at])
        power, unpower = _powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTES[lower][data[starts[at]:end]] * power[:size], out=sums[1:])
        hashes[at:last] = _mix((sums[np.append(own[1:], size)] - sums[own]) * unpower[own])
        at = last
    return hashes, counts


def shingles(hashes: np.ndarray, starts: np.ndarray, k: int = 5) -> Words:
    """Hashes of all runs of ``k`` words of each text; a shorter text is one run, an empty one none."""
    n = np.diff(starts)
    total = len(hashes)
    owner = np.repeat(np.arange(len(n)), n)
    value = np.zeros(total, np.uint64)
    keep = np.zeros(total, bool)
    if total >= k:
        run = hashes[:total - k + 1] + np.uint64(k)
        for j in range(1, k):
            run = _mix(run) + hashes[j:total - k + 1 + j]
        value[:total - k + 1] = _mix(run)
        keep[:total - k + 1] = owner[:total - k + 1] == owner[k - 1:]
    for m in range(1, k):
        at = starts[:-1][n == m]
        run = np.uint64(m) + hashes[at]
        for j in range(1, m):
            run = _mix(run) + hashes[at + j]
        value[at] = _mix(run)
        keep[at] = True
    kept = np.concatenate([[0], np.cumsum(np.where(n >= k, n - k + 1, np.minimum(n, 1)))])
    return value[keep], kept


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text; a longer text is a part of its own.

    Parts are copied out of the batch: some Arrow functions misread arrays that start inside a buffer.  At the end
    Arrow gives the memory it no longer needs back: a worker that waits for its next task would keep it.
    """
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    total = np.concatenate([[0], np.cumsum(size)])
    while at < len(size):
        last = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield pa.ipc.read_record_batch(batch.slice(at, last - at).serialize(), batch.schema)
        at = last
    pa.default_memory_pool().release_unused()
