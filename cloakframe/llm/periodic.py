"""Periodic runs of words, by recompression.

The words of a text are compressed level by level, blocks of one symbol and
then pairs of symbols in turn, into a run-length grammar of logarithmic depth.
The parse depends on the symbols alone, so equal stretches are compressed alike
except at their borders, and the longest common extension of two places is
found by climbing and descending the levels once.  A run of period ``q`` that
is three periods long holds two neighbouring multiples of ``q``; these grid
pairs (n/1 + n/2 + n/3 ... of them) are the candidates, and their exact
extensions to both sides are grammar queries.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _mix, blocks, raw_bytes, shingles, table, words

# A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
# With both, the grid pair of a run agrees on at least nine words to the right; windows of eight tell most other pairs apart.
WINDOW = 8
# Grid pairs looked at together.
PAIRS = 1 << 20
# Bytes of text worked on together.
TEXTS = 2 << 20

# First and period of the words to repeat in place of a text's own, for its identifier and number of words.
Edit = Callable[[int, int], "tuple[int, int] | None"]


class Level:
    """Symbols of one level, where the texts start in it, and the rule that makes the next level.

    ``hold`` says for every place how many symbols lie before the next border
    that the rule sets whatever stands before: the rest of its block, or one
    symbol if that can only end a pair.  ``up`` is the place in the next level,
    ``first`` (of the next level's places) the first symbol below.
    """

    __slots__ = ("symbols", "starts", "hold", "up", "first")

    def __init__(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        self.symbols, self.starts = symbols, starts


class Grammar:
    """Run-length grammar of several sequences side by side; equal symbols stand for equal words in all of them."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        self.levels = [Level(symbols.astype(np.int64), starts.astype(np.int64))]
        self.names = int(symbols.max()) + 1 if len(symbols) else 0
        turn = 0
        while len(self.levels[-1].symbols) > len(starts) - 1 - np.count_nonzero(np.diff(starts) == 0):
            (self._pairs if turn % 2 else self._blocks)(self.levels[-1], turn)
            turn += 1

    def _next(self, level: Level, first: np.ndarray, symbols: np.ndarray) -> None:
        level.first = first
        level.up = np.zeros(len(level.symbols) + 1, np.int64)
        level.up[first] = 1
        level.up = np.cumsum(level.up) - 1
        level.up[-1] = len(first)
        self.levels.append(Level(symbols, level.up[level.starts]))

    def _blocks(self, level: Level, turn: int) -> None:
        """Every stretch of one symbol becomes one symbol."""
        s = level.symbols
        head = np.ones(len(s), bool)
        head[1:] = s[1:] != s[:-1]
        head[level.starts[:-1][level.starts[:-1] < len(s)]] = True
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(s)))
        level.hold = np.repeat(first + size, size) - np.arange(len(s))
        made = s[first].copy()
        several = size > 1
        made[several] = self._named(made[several] * (int(size.max(initial=1)) + 1) + size[several])
        self._next(level, first, made)

    def _pairs(self, level: Level, turn: int) -> None:
        """Symbols are parted by a bit of their hash; a left one followed by a right one becomes one symbol."""
        s = level.symbols
        right = (_mix(s.astype(np.uint64) + np.uint64(turn << 40)) >> np.uint64(33)) & np.uint64(1) == 1
        inside = np.ones(len(s) - 1, bool)  # neighbours in the same text
        cuts = level.starts[1:-1]
        inside[cuts[(cuts > 0) & (cuts < len(s))] - 1] = False
        if np.count_nonzero(inside & right[:-1] & ~right[1:]) > np.count_nonzero(inside & ~right[:-1] & right[1:]):
            right = ~right
        joins = inside & ~right[:-1] & right[1:]
        level.hold = right.astype(np.int64)
        head = np.ones(len(s), bool)
        head[1:] = ~joins
        first = np.flatnonzero(head)
        made = s[first].copy()
        several = np.flatnonzero(np.append(joins, False)[first])
        made[several] = self._named(s[first[several]] * self.names + s[first[several] + 1])
        self._next(level, first, made)

    def _named(self, keys: np.ndarray) -> np.ndarray:
        kinds, codes = np.unique(keys, return_inverse=True)
        codes = codes + self.names
        self.names += len(kinds)
        return codes

    def common(self, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places ``i`` and from later places ``j`` of the same ``text`` are equal one by one."""
        end = self.levels[0].starts[text + 1]
        found = end - j  # until a difference is met before the end
        open_ = np.flatnonzero(j < end)
        u, v = i[open_], j[open_]
        differs: list[tuple] = []  # per level: queries that meet a difference there
        for level in self.levels[:-1]:
            same = level.symbols[u] == level.symbols[v]
            # Equal symbols before a border are passed; unequal rests of two blocks end in a difference.
            left, other = level.hold[u], level.hold[v]
            step = np.where(same, np.minimum(left, other), 0)
            u, v = u + step, v + step
            going = v < level.starts[text[open_] + 1]
            split = going & (~same | (left != other))
            differs.append((open_[split], u[split], v[split]))
            go = going & ~split
            open_, u, v = open_[go], level.up[u[go]], level.up[v[go]]
        held, u, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(len(differs) - 1, -1, -1):
            level = self.levels[k]
            if len(held):
                u, v = level.first[u], level.first[v]
                same = level.symbols[u] == level.symbols[v]
                # Of pairs at most the first symbol is equal; of blocks of one symbol the shorter one.
                width = np.maximum(np.minimum(level.hold[u], level.hold[v]), 1)
                step = np.where(same, width, 0)
                u, v = u + step, v + step
                going = v < level.starts[text[held] + 1]
                held, u, v = held[going], u[going], v[going]
            more, mu, mv = differs[k]
            held, u, v = np.concatenate([held, more]), np.concatenate([u, mu]), np.concatenate([v, mv])
        found[held] = u - i[held]
        return found


def _grid(windows: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(place, period)`` of the grid pairs of a text of ``n`` words whose windows are equal."""
    periods = np.arange(1, n // LEAST_PERIODS + 1)
    counts = np.maximum((len(windows) - 1) // periods, 0)
    total = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(periods):
        last = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        q = np.repeat(periods[at:last], counts[at:last])
        i = (np.arange(total[at], total[last]) - np.repeat(total[at:last], counts[at:last])) * q
        same = windows[i] == windows[i + q]
        yield i[same], q[same]
        at = last


def runs(texts: list[list[bytes]], windows: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of every run of each text, by start and period.

    ``windows`` has a hash of every eight words of a text; equal words have
    equal windows, and the grammar decides.
    """
    ids: dict[bytes, int] = {}
    symbols = [np.fromiter((ids.setdefault(w, len(ids)) for w in t), np.int64, len(t)) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in symbols])]).astype(np.int64)
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    if not texts:
        return []
    forth = Grammar(np.concatenate(symbols), starts)
    back = Grammar(np.concatenate([s[::-1] for s in symbols]), starts)
    held: list[tuple] = []

    def answer() -> None:
        text = np.concatenate([np.full(len(i), k) for k, i, _ in held])
        i, q = np.concatenate([i for _, i, _ in held]), np.concatenate([q for _, _, q in held])
        held.clear()
        begin, end = starts[text], starts[text + 1]
        after = forth.common(text, begin + i, begin + i + q)
        # The words before both places, in the reversed text.
        before = back.common(text, end - i - q, end - i)
        length = before + q + after
        kept = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        rows = np.unique(np.stack([text[kept], (i - before)[kept], length[kept], q[kept]]), axis=1)
        for k, start, size, period in rows.T.tolist():
            # Of the periods of one stretch the smallest comes first.
            found[k][start, size] = min(period, found[k].get((start, size), period))

    waiting = 0
    for k, own in enumerate(windows):
        for i, q in _grid(own, len(texts[k])):
            held.append((k, i, q))
            waiting += len(i)
            if waiting >= PAIRS:
                answer()
                waiting = 0
    if held:
        answer()
    return [sorted(((s, n, q) for (s, n), q in f.items()), key=lambda r: (r[0], r[2])) for f in found]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period; ties go to the smaller start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _collapsed(own: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period, parted by one space."""
    if not found:
        return b" ".join(own)
    inside = np.zeros(len(own) + 1, np.int64)
    for start, length, period in found:
        inside[start + period] += 1
        inside[start + length] -= 1
    kept = np.cumsum(inside[:-1]) == 0
    return b" ".join([w for w, k in zip(own, kept.tolist()) if k])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None) -> DataFrame:
    """``id_col, runs, strongest, collapsed``: one row per row of ``docs``.

    A run is a longest stretch of words (parted by white space, compared byte
    by byte) with a smallest period, of at least ``LEAST_WORDS`` words and
    ``LEAST_PERIODS`` periods.  ``runs`` is ``array<struct<start, length,
    period>>`` by start and period, ``strongest`` the one of greatest length
    over period or null, ``collapsed`` the words that do not repeat an earlier
    part of a run, parted by one space.  A null text counts as empty: no runs,
    an empty collapsed text.  Each row of a repeated text or identifier is
    judged by itself; other columns are ignored.  ``edit`` puts repeated words
    in place of a text's own from some word on; a row without identifier is
    not edited.  A text is worked on as a whole by one task; memory grows with
    its number of words.
    """
    def run(batches):
        for batch in batches:
            for part in blocks(batch, "_t", TEXTS):
                data, ends = raw_bytes(part.column("_t"))
                hashes, starts = words(data, ends, lower=False)
                n = np.diff(starts)
                order: dict[int, np.ndarray] = {}
                if edit is not None:
                    for k, key in enumerate(part.column("_id").to_pylist()):
                        change = edit(key, int(n[k])) if key is not None and n[k] else None
                        if change is not None:
                            order[k] = np.arange(n[k])
                            order[k][change[0]:] = change[0] + np.arange(n[k] - change[0]) % change[1]
                            hashes[starts[k]:starts[k + 1]] = hashes[starts[k] + order[k]]
                windows, at = shingles(hashes, starts, WINDOW)
                # Texts none of whose windows stands in them twice have no run.
                owner = np.repeat(np.arange(len(n)), np.diff(at))
                named = np.sort(_mix(windows + _mix(owner.astype(np.uint64))))
                twice = np.isin(_mix(windows + _mix(owner.astype(np.uint64))), named[1:][named[1:] == named[:-1]])
                likely = np.unique(owner[twice])
                likely = likely[n[likely] >= LEAST_WORDS]
                own = [data[a:b].tobytes().split() for a, b in zip(ends[:-1], ends[1:])]
                for k, places in order.items():
                    own[k] = [own[k][i] for i in places.tolist()]
                found: list[list] = [[] for _ in own]
                for k, r in zip(likely.tolist(), runs([own[k] for k in likely], [windows[at[k]:at[k + 1]] for k in likely])):
                    found[k] = r
                listed = [[dict(zip(("start", "length", "period"), r)) for r in f] for f in found]
                best = [strongest(f) for f in found]
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), pa.array(listed, pa.list_(_RUN)),
                    pa.array([b and dict(zip(("start", "length", "period"), b)) for b in best], _RUN),
                    pa.array([_collapsed(w, f).decode() for w, f in zip(own, found)], pa.string())],
                    ["_id", "runs", "strongest", "collapsed"])

    one = "struct<start:bigint,length:bigint,period:bigint>"
    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")).mapInArrow(
        run, f"_id bigint, runs array<{one}>, strongest {one}, collapsed string").withColumnRenamed("_id", id_col)


def planted(key: int, n: int) -> tuple[int, int] | None:
    """Where the query repeats words, by the identifier's checksum."""
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of all documents; in one of ten, chosen by checksum, words are repeated first."""
    found = periodic_runs(table(spark, folder, "documents"), edit=planted)
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
