"""Language model scores: exact unigram counts and a probabilistic suffix tree.

A text is read as a stream of bytes: its words, each with a space before and
after it, and its end.  The tree predicts the next byte from the bytes before
it, across word borders.  Contexts of several lengths are kept where their
next-byte distribution diverges from that of the next shorter context; a byte
is scored by the longest kept suffix of what precedes it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _IS_SPACE, _mix, blocks, cut, partitions, raw_bytes, table
from .common import words as _word_hashes
from .families import lists, packed

# Longest context in bytes; codes have room for ROOM.
DEPTH = 6
ROOM = 7
# A context is kept only if it was seen this often, at any size of the input.
LEAST_SEEN = 24
# Least divergence from the shorter context, in nats over all its occurrences.
DIVERGENCE = 12.0
# Probability that every symbol has in every state.
LEAST = 1e-5
SPACE, END = 32, 10
SYMBOLS = 256
# Words above one in so many tokens, of at most LONGEST bytes, are broadcast with their counts: at most FREQUENT words.
FREQUENT = 4_000_000
LONGEST = 32
TEXTS = 3 << 20
# Texts are turned into contexts in blocks of this many bytes, and a task counts this many symbols at a time.
GRAMS = 1 << 20
GATHERED = 5 << 20
# Counts are packed, at most PACKED a row, by the lot of their SHARED bytes: LOTS lots for each shuffle partition.
PACKED = 32
LOTS = 32
# A tree of more (context, symbol) rows meets the texts by shuffle.
BROADCAST_TREE = 6_000_000
# Contexts that share SHARED bytes are in one lot; shorter contexts are summed over tasks.  A task grows lots of CHUNK counts at a time.
SHARED = min(3, DEPTH)
CHUNK = 1 << 18
# Seed of the 64-bit hash by which Spark and the workers name rare words alike.
SEED = 42
# The end of a text is counted under this key, which no word can equal.
END_KEY = " "

# A-Z lowered.  255, which UTF-8 never uses, fills the codes of short contexts and is no symbol.
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[65:91] += 32
_SYMBOL[255] = 254


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words with A-Z lowered: where each text's entries start, and the entries as codes (the empty one is no word)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.large_string())))
    starts = lists.offsets.to_numpy()
    return starts - starts[0], lists.flatten().dictionary_encode()


def word_names(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each entry, which is a word or empty (0)."""
    hashes, starts = _word_hashes(*raw_bytes(words), lower=False)
    names = np.zeros(len(words), np.uint64)
    names[np.diff(starts) > 0] = hashes
    return names


def word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """``word, c`` over all texts, text ends included under ``END_KEY``; blocks are summed before the shuffle."""
    def count(batches):
        for batch in batches:
            for part in blocks(batch, text_col, TEXTS):
                _, entries = _tokens(part.column(text_col))
                n = np.bincount(entries.indices.to_numpy(zero_copy_only=False), minlength=len(entries.dictionary))
                words = pa.concat_arrays([entries.dictionary.cast(pa.string()), pa.array([END_KEY])])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, len(part)), pa.int64())], ["word", "n"])

    return train.select(text_col).mapInArrow(count, "word string, n bigint").filter("word != ''") \
        .groupBy("word").agg(F.sum("n").alias("c"))


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the texts in a row, and where each text starts.

    A text starts with ``ROOM`` symbols that are never predicted, ends and a
    space; its words follow, each with a space after it, and its end.
    """
    data, ends = raw_bytes(texts)
    inside = ~_IS_SPACE[data]
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    first = ends[:-1][np.diff(ends) > 0]
    kept[first] = inside[first]
    sums = np.concatenate([[0], np.cumsum(kept)])
    sizes = np.diff(sums[ends])
    open_ = np.zeros(len(sizes), np.int64)  # the last word has no white space after it
    some = np.diff(ends) > 0
    open_[some] = inside[ends[1:][some] - 1]
    starts = np.concatenate([[0], np.cumsum(sizes + open_ + ROOM + 1)])
    row = np.full(starts[-1], END, np.uint8)
    row[starts[:-1] + ROOM - 1] = SPACE
    row[starts[1:][open_ > 0] - 2] = SPACE
    row[np.arange(sums[-1]) + np.repeat(starts[:-1] + ROOM - sums[ends[:-1]], sizes)] = np.where(inside, _SYMBOL[data], SPACE)[kept]
    return row, starts


def grams(row: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code of every predicted symbol and its longest context: the latest byte of the context highest, the symbol lowest."""
    if not len(row):
        return np.zeros(0, np.uint64)
    window = np.zeros(len(row) - ROOM, np.uint64)
    for j in range(min(ROOM + 1, len(window))):
        own = window[j::ROOM + 1]
        own[:] = np.frombuffer(row, "<u8", len(own), j)
    inside = np.ones(len(window), bool)
    inside[(starts[1:-1, None] - 1 - np.arange(ROOM)).ravel()] = False
    window = window[inside]
    symbol = window >> np.uint64(56)
    window <<= np.uint64(8)
    window |= symbol
    return shortened(window, DEPTH)


def shortened(codes: np.ndarray, depth: int) -> np.ndarray:
    """The codes with contexts of ``depth`` bytes; the room of older ones is filled."""
    return codes | np.uint64((1 << 64) - (1 << 8) & ((1 << 8 * (ROOM + 1 - depth)) - 1))


def text_grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(codes, starts)`` of the texts block by block, and where each text's codes start."""
    for part in blocks(pa.RecordBatch.from_arrays([texts], ["_t"]), "_t", GRAMS):
        # The block's codes are handed on without a name here, so that whoever takes them can let them go.
        yield _part_grams(part.column("_t"))


def _part_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    row, starts = symbols(texts)
    return grams(row, starts), starts - ROOM * np.arange(len(starts))


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def packed_counts(codes: np.ndarray, n: np.ndarray, lots: int) -> Iterator[pa.RecordBatch]:
    """``lot, grams``: the counted codes as pairs of code and count, many to a row, each row of one lot."""
    first = runs(codes >> np.uint64(64 - 8 * SHARED))
    lot = (_mix(codes[first] >> np.uint64(64 - 8 * SHARED)) % np.uint64(lots)).astype(np.int32)
    order = np.argsort(lot, kind="stable")
    lot, sizes = lot[order], np.diff(first, append=len(codes))[order]
    ends = np.cumsum(sizes)
    at = np.repeat(first[order] - ends + sizes, sizes)
    at += np.arange(len(codes))
    own = runs(lot)
    lot, starts = lot[own], (ends - sizes)[own]
    rows = -(-np.diff(starts, append=len(codes)) // PACKED)
    starts = np.repeat(starts - PACKED * (np.cumsum(rows) - rows), rows) + PACKED * np.arange(rows.sum())
    lot, starts = np.repeat(lot, rows), np.append(starts, len(codes))
    for i in range(0, len(lot), CHUNK // PACKED):
        bounds = starts[i:i + CHUNK // PACKED + 1]
        where = at[bounds[0]:bounds[-1]]
        pairs = np.stack([codes[where].view(np.int64), n[where]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(lot[i:i + len(bounds) - 1]), packed(pairs, 2 * (bounds - bounds[0]))], ["lot", "grams"])


def gram_counts(texts: DataFrame) -> DataFrame:
    """``lot, grams`` of the texts in the first column, summed per task; ``c``, if there, says how often a text counts."""
    name = texts.columns[0]
    lots = LOTS * partitions(texts.sparkSession)
    if "c" in texts.columns:
        texts = texts.select(name, F.explode(F.sequence(F.lit(1).cast("long"), "c")))

    def counted(codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes.sort()
        first = runs(codes)
        yield from packed_counts(codes[first], np.diff(first, append=len(codes)), lots)

    def count(batches):
        held, n = np.empty(GATHERED, np.uint64), 0
        for batch in batches:
            for codes, _ in text_grams(batch.column(name)):
                if n + len(codes) > len(held):
                    yield from counted(held[:n])
                    n = 0
                if len(codes) > len(held):  # of one long text
                    yield from counted(codes)
                else:
                    held[n:n + len(codes)] = codes
                    n += len(codes)
                del codes
        yield from counted(held[:n])

    return texts.select(name).mapInArrow(count, "lot int, grams binary")


def packed_grams(counted: DataFrame) -> DataFrame:
    """``gram, n`` in packed rows as ``gram_counts`` gives them."""
    lots = LOTS * partitions(counted.sparkSession)

    def pack(batches):
        for batch in batches:
            yield from packed_counts(batch.column("gram").to_numpy().view(np.uint64), batch.column("n").to_numpy(), lots)

    return counted.select("gram", "n").mapInArrow(pack, "lot int, grams binary")


def whole_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``codes, n`` of whole lots, about ``CHUNK`` counts at a time; the rows of a lot follow each other.

    A larger lot is summed as it is read, so a code that many rows count is held once.
    """
    done: list[np.ndarray] = []
    own: list[np.ndarray] = []
    last, most = None, CHUNK
    for batch in batches:
        lots = batch.column("lot").to_numpy()
        values, starts = lists(batch.column("grams"))
        first = runs(lots)
        for a, b in zip(first, np.append(first[1:], len(lots))):
            if lots[a] != last:
                done += own
                own, last, most = [], lots[a], CHUNK
                if sum(map(len, done)) >= CHUNK:
                    yield _columns(done)
                    done = []
            # A copy, which does not keep the batch.
            own.append(values[starts[a]:starts[b]].reshape(-1, 2).copy())
            if sum(map(len, own)) > most:
                codes, n = _summed(*_columns(own))
                own = [np.stack([codes, n.view(np.uint64)], axis=1)]
                most = max(CHUNK, 2 * len(codes))
    if done + own:
        yield _columns(done + own)


def _columns(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.concatenate(pairs)
    return rows[:, 0], rows[:, 1].view(np.int64)


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    first = runs(codes)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _totals(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row how often its context was seen."""
    first = runs(codes >> np.uint64(8))
    return np.repeat(np.add.reduceat(n, first), np.diff(first, append=len(codes))) if len(first) else n


def grown(codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``codes, n, totals``: all rows of ``SHARED`` bytes of context, then the kept rows of each longer context."""
    levels = [_summed(codes, n)]
    for depth in range(DEPTH - 1, SHARED - 1, -1):
        levels.append(_summed(shortened(levels[-1][0], depth), levels[-1][1]))
    shorter = levels.pop()
    totals = _totals(*shorter)
    yield *shorter, totals
    for depth in range(SHARED + 1, DEPTH + 1):
        own = levels.pop()
        seen = _totals(*own)
        at = np.searchsorted(shorter[0], shortened(own[0], depth - 1))
        gain = own[1] * np.log(own[1] / seen * totals[at] / shorter[1][at])
        first = runs(own[0] >> np.uint64(8))
        kept = np.repeat((np.add.reduceat(gain, first) >= DIVERGENCE) & (seen[first] >= LEAST_SEEN), np.diff(first, append=len(seen)))
        yield own[0][kept], own[1][kept], seen[kept]
        shorter, totals = own, seen


def tree(counted: DataFrame) -> DataFrame:
    """Kept contexts with their next-symbol counts: ``context, symbol, n, total``; of packed counts or of rows ``gram, n``.

    A context seen less than ``LEAST_SEEN`` times is dropped; of the rest those
    stay whose distribution differs enough from that of the context one symbol
    shorter (log-likelihood ratio).  The empty context always stays.  So the
    tree grows with the variety of the input.
    """
    spark = counted.sparkSession

    def grow(batches):
        for lots in whole_lots(batches):
            for i, (codes, n, totals) in enumerate(grown(*lots)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((codes >> np.uint64(8)).view(np.int64)), pa.array((codes & np.uint64(255)).astype(np.int32)), pa.array(n),
                     pa.array(totals), pa.array(np.full(len(n), i == 0))], ["context", "symbol", "n", "total", "shared"])

    if "gram" in counted.columns:
        counted = packed_grams(counted)
    whole = cut(counted.repartition(partitions(spark), "lot").sortWithinPartitions("lot")
                .mapInArrow(grow, "context bigint, symbol int, n bigint, total bigint, shared boolean"), "contexts")
    # The fill of a short context: all but its first bytes.
    filled = [(1 << 8 * (ROOM - d)) - 1 for d in range(SHARED + 1)]
    own = whole.filter("shared").select(F.explode(F.array([F.struct(
        F.col("context").bitwiseOR(F.lit(m)).alias("context"), F.lit(d).alias("depth")) for d, m in enumerate(filled)])).alias("_c"), "symbol", "n") \
        .groupBy("_c.context", "_c.depth", "symbol").agg(F.sum("n").alias("n")) \
        .withColumn("total", F.sum("n").over(Window.partitionBy("context")))
    shorter = own.select(F.col("context").alias("_c"), F.col("symbol").alias("_s"), (F.col("n") / F.col("total")).alias("_p"))
    below = F.element_at(F.array([F.lit(m) for m in filled]), F.col("depth"))  # that of the depth before: positions count from one
    kept = (
        own.filter(f"depth > 0 and total >= {LEAST_SEEN}").withColumn("_below", F.col("context").bitwiseOR(below))
        .join(shorter, (F.col("_below") == F.col("_c")) & (F.col("symbol") == F.col("_s")))
        .groupBy("context").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("_p"))).alias("_d"))
        .filter(F.col("_d") >= DIVERGENCE).select("context")
    )
    columns = ["context", "symbol", "n", "total"]
    return own.filter("depth = 0").select(columns).unionByName(own.join(kept, "context").select(columns)) \
        .unionByName(whole.filter("not shared").select(columns))


class Tree:
    """The kept contexts as sorted arrays, with smoothed log10 probabilities."""

    def __init__(self, rows: pa.Table) -> None:
        context = rows["context"].to_numpy().astype(np.uint64)
        keys = (context << np.uint64(8)) | rows["symbol"].to_numpy().astype(np.uint64)
        chance = (1 - SYMBOLS * LEAST) * rows["n"].to_numpy() / np.maximum(rows["total"].to_numpy(), 1) + LEAST
        order = np.argsort(keys)
        self._hold(keys[order], np.log10(chance[order]))

    def _hold(self, keys: np.ndarray, log10: np.ndarray) -> None:
        self.keys, self.log10 = keys, log10
        self.contexts = keys[runs(keys >> np.uint64(8))] >> np.uint64(8)
        self.other = math.log10(LEAST) if len(keys) else -math.log10(SYMBOLS)

    @classmethod
    def of(cls, keys: np.ndarray, log10: np.ndarray) -> Tree:
        """The tree of ``collected`` arrays."""
        made = cls.__new__(cls)
        made._hold(keys, log10)
        return made

    def code_scores(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code, which stand in order: that of its symbol after the longest kept context."""
        if not len(self.keys):
            return np.full(len(codes), self.other)
        first = runs(codes >> np.uint64(8))
        own = codes[first] >> np.uint64(8)
        state = np.full(len(own), (1 << 8 * ROOM) - 1, np.uint64)
        for depth in range(1, DEPTH + 1):
            shorter = own | np.uint64((1 << 8 * (ROOM - depth)) - 1)
            once = runs(shorter)
            at = np.minimum(np.searchsorted(self.contexts, shorter[once]), len(self.contexts) - 1)
            found = np.repeat(self.contexts[at] == shorter[once], np.diff(once, append=len(own)))
            state[found] = shorter[found]
        keys = (np.repeat(state, np.diff(first, append=len(codes))) << np.uint64(8)) | (codes & np.uint64(255))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.log10[at], self.other)

    def word_scores(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of the words of every text, with the spaces between and after them, and of its end."""
        # Nothing of a block is held while the next one is made.
        sums = list(starmap(self._block_scores, text_grams(texts)))
        return np.concatenate(sums) if sums else np.zeros(0)

    def _block_scores(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        # Places in the order of a part of the codes' hashes: sorting plain numbers is several times faster than argsort.
        width = np.uint64(len(codes).bit_length())
        order = _mix(codes)
        order >>= width
        order <<= width
        order |= np.arange(len(codes), dtype=np.uint64)
        order.sort()
        order &= (np.uint64(1) << width) - np.uint64(1)
        order = order.view(np.int64)
        sorted_ = codes[order]
        first = runs(sorted_)
        distinct = sorted_[first]
        del sorted_
        by_code = np.argsort(distinct)
        own = np.empty(len(distinct))
        own[by_code] = self.code_scores(distinct[by_code])
        del distinct, by_code
        scores = np.empty(len(codes))
        scores[order] = np.repeat(own, np.diff(first, append=len(codes)))
        return np.add.reduceat(scores, starts[:-1])


def _log10() -> Column:
    return F.log10(F.coalesce((1 - SYMBOLS * LEAST) * F.col("n") / F.col("total"), F.lit(0.0)) + LEAST)


def collected(kept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all rows of the tree in order and their log10 probabilities; Spark sorts them, so the driver holds little more."""
    rows = kept.select(F.shiftleft("context", 8).bitwiseOR(F.col("symbol").cast("bigint")).alias("key"), _log10().alias("lp")) \
        .orderBy("key").toArrow()
    keys, log10 = rows["key"].to_numpy(), rows["lp"].to_numpy()
    at = np.searchsorted(keys, 0)  # Spark's numbers have a sign: the upper half of the codes comes first
    return np.concatenate([keys[at:], keys[:at]]).view(np.uint64), np.concatenate([log10[at:], log10[:at]])


def code_scores(codes: DataFrame, kept: DataFrame) -> DataFrame:
    """``gram, lp`` for the distinct ``gram`` of ``codes``: what ``Tree.code_scores`` gives, by joins with the written tree."""
    distinct = codes.select("gram").distinct().withColumn("_own", F.shiftrightunsigned("gram", 8))
    # Of the contexts that begin alike the longest has the smallest code.
    states = distinct.select("_own").distinct().withColumn("context", F.explode(F.array_distinct(F.array(
        [F.col("_own").bitwiseOR(F.lit((1 << 8 * (ROOM - d)) - 1)) for d in range(DEPTH + 1)])))) \
        .join(kept.select("context").distinct(), "context").groupBy("_own").agg(F.min("context").alias("context"))
    return distinct.join(states, "_own").withColumn("symbol", F.col("gram").bitwiseAND(F.lit(255)).cast("int")) \
        .join(kept, ["context", "symbol"], "left").select(
            "gram", _log10().alias("lp"))


def score_texts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all ``docs`` by a model of the texts of ``train``: one row per row of ``docs``.

    Columns: ``id_col``, ``n_tokens`` (words and one end), ``n_known`` (tokens
    seen in training), ``train_tokens``, ``base_score`` (add-one unigrams) and
    ``score`` (the tree).  A null text counts as empty: its end is its only
    token.  Without training texts every symbol has the same chance.  Rows
    that repeat an identifier are scored one by one.

    Counts of frequent words are broadcast (at most ``FREQUENT`` short words);
    occurrences of all other words meet their counts in one join, on a 64-bit
    hash of the word.  The tree is broadcast up to ``BROADCAST_TREE`` rows;
    beyond, the distinct contexts of the texts meet it by joins.
    """
    spark = docs.sparkSession
    counts = cut(word_counts(train, text_col), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    kept = cut(tree(gram_counts(train.select(text_col))), "tree")
    few = kept.limit(BROADCAST_TREE + 1).count() <= BROADCAST_TREE
    frequent = counts.filter((F.col("c") * FREQUENT >= total) & (F.octet_length("word") <= LONGEST)).toArrow()
    ends = frequent.filter(pc.equal(frequent["word"], END_KEY))["c"].to_pylist()
    frequent = frequent.filter(pc.not_equal(frequent["word"], END_KEY))
    names = word_names(frequent["word"].combine_chunks())
    order = np.argsort(names)
    index = (names[order], np.append(frequent["c"].to_numpy()[order], 0))
    del frequent, names, order
    pa.default_memory_pool().release_unused()
    # The workers get one number and one count per frequent word, in order, and search them: no table of words is built again.
    shared = spark.sparkContext.broadcast((collected(kept) if few else None, *index, ends[0] if ends else 0))

    def run(batches):
        arrays, known, times, ends = shared.value
        model = Tree.of(*arrays) if few else None
        logs = np.log10(times + 1.0)
        for batch in batches:
            for part in blocks(batch, "_t", TEXTS):
                starts, entries = _tokens(part.column("_t"))
                codes = entries.indices.to_numpy(zero_copy_only=False)
                words = entries.dictionary
                real = ~pc.equal(words, "").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
                own = word_names(words)
                at = np.searchsorted(known, own)
                at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] != own) if len(known) else slice(None)] = len(known)
                rare = real & (at == len(known))

                def per_text(values):
                    sums = np.concatenate([[0], np.cumsum(values[codes])])
                    return sums[starts[1:]] - sums[starts[:-1]]

                n = len(part)
                keys = part.column("_k")
                text = pa.StructArray.from_arrays([
                    part.column("_id"), pa.array(per_text(real.astype(np.int64)) + 1, pa.int64()),
                    pa.array(per_text((real & (at < len(known))).astype(np.int64)) + (ends > 0), pa.int64()),
                    pa.array(per_text(np.where(real, logs[at], 0.0)) + math.log10(ends + 1), pa.float64()),
                    pa.array(model.word_scores(part.column("_t")) if few else np.zeros(n), pa.float64())], ["id", "n_tokens", "known", "logs", "score"])
                # The row of the text itself carries no word: its hash is only there to spread such rows.
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(keys.to_numpy() * np.int64(0x9E3779B97F4A7C1)), pa.array(np.zeros(n, np.int64)), text, pa.nulls(n, pa.int64())], columns)
                names_of = np.zeros(len(words), np.uint64)
                spelled = words.take(pa.array(np.flatnonzero(rare))).to_pylist()
                names_of[rare] = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in spelled), np.uint64, len(spelled))
                names_of = names_of.view(np.int64)
                where = np.flatnonzero(rare[codes])
                owner = np.searchsorted(starts, where, side="right") - 1
                pairs, often = np.unique(owner * len(words) + codes[where], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(pairs // max(1, len(words)))), pa.array(names_of[pairs % max(1, len(words))]),
                    pa.array(often, pa.int64()), pa.nulls(len(pairs), text.type), pa.nulls(len(pairs), pa.int64())], columns)
                at = 0
                for codes, begins in text_grams(part.column("_t")) if not few else ():
                    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
                    order = np.lexsort((codes, owner))
                    owner, codes = owner[order], codes[order]
                    first = np.union1d(runs(owner), runs(codes))
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(at + owner[first])), pa.nulls(len(first), pa.int64()),
                        pa.array(np.diff(first, append=len(codes))), pa.nulls(len(first), text.type),
                        pa.array(codes[first].view(np.int64))], columns)
                    at += len(begins) - 1

    columns = ["_k", "h", "k", "text", "gram"]
    id_type = docs.schema[id_col].dataType.simpleString()
    # Rows are told apart by their place in the scan, which a rerun of a task repeats.
    rows = docs.select(F.monotonically_increasing_id().alias("_k"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t")) \
        .mapInArrow(run, f"_k bigint, h bigint, k bigint, text struct<id:{id_type},n_tokens:bigint,known:bigint,logs:double,score:double>, gram bigint")
    if not few:
        rows = cut(rows, "occurrences")
    met = rows.filter("gram is null").join(counts.select(F.xxhash64("word").alias("h"), "c"), "h", "left").withColumn("lp", F.lit(0.0))
    if not few:
        own = rows.filter("gram is not null")
        met = met.unionByName(own.join(code_scores(own, kept), "gram").select(
            "_k", (F.col("k") * F.col("lp")).alias("lp"), F.lit(0).cast("long").alias("k")), allowMissingColumns=True)
    return met.groupBy("_k").agg(
        F.max("text.id").alias(id_col), F.max("text.n_tokens").alias("n_tokens"),
        (F.max("text.known") + F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.max("text.logs") + F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1)) -
         F.max("text.n_tokens") * math.log10(int(total) + int(kinds) + 1)).alias("base_score"),
        (F.max("text.score") + F.sum("lp")).alias("score")).drop("_k")


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents; one in seven is held out of the model by its identifier's checksum."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_texts(docs, docs.filter(~held)).withColumn("held_out", held)
