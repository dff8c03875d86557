"""One large JSON document read by many tasks.

A file is read in pieces that end at ``}``, which Spark's text reader cuts in
parallel splits.  Whether a place lies inside a string, and how deep, follows
from everything before it; a split reports both possible answers as a few
numbers, and running sums over the splits of a file tell which one holds.
With that every split finds the items of the top-level list (or of the list
under ``records``) by itself.  Only items that cross a border between splits
are put together by a shuffle.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import FILE_PATH

_RECORDS_KEY = re.compile(rb'"records"[ \t\r\n]*:[ \t\r\n]*\[')
_BLANK = b" \t\r\n"
_END = "}"
# White space, and the bytes of a byte order mark, which begin no value.
_SKIPPED = np.array([9, 10, 13, 32, 0xEF, 0xBB, 0xBF], np.uint8)


def structure(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, and for each whether an odd number of string marks stands before it or at it."""
    own = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(own == 34)
    if (own == 92).any():
        # A mark after an odd number of backslashes is part of its string.
        other = np.maximum.accumulate(np.where(own != 92, np.arange(len(own)), -1))
        before = np.where(marks > 0, other[marks - 1], -1)
        marks = marks[(marks - 1 - before) % 2 == 0]
    odd = np.zeros(len(own), np.int8)
    odd[marks] = 1
    return own, np.cumsum(odd, dtype=np.int64) % 2 == 1


def depths(own: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """How many brackets are open after each byte, counted from the start of the data."""
    step = ((own == 91) | (own == 123)).astype(np.int64) - ((own == 93) | (own == 125))
    return np.cumsum(step * outside)


@dataclass
class Opening:
    """A list that may hold the records: where it opens in the split, its depth, the commas at that depth, its end, and bytes behind it."""

    at: int
    depth: int
    commas: int = 0
    closed: bool = False
    behind: int = 0


@dataclass
class Summary:
    """What a split says about itself if it starts outside (or inside) a string; depths count from its start."""

    odd: bool = False
    depth: int = 0
    least: int = 0
    commas: dict[int, int] = field(default_factory=dict)
    root: Opening | None = None
    lists: dict[int, Opening] = field(default_factory=dict)
    size: int = 0
    first: int = 0
    # Ends of brackets at depth zero, line ends outside strings, and bytes that are not blank.
    values: int = 0
    breaks: int = 0
    filled: int = 0

    def read(self, data: bytes, own: np.ndarray, odd: np.ndarray, inside: bool) -> None:
        odd = odd ^ self.odd
        outside = odd == inside
        deep = depths(own, outside) + self.depth
        comma = outside & (own == 44)
        for depth, n in zip(*np.unique(deep[comma], return_counts=True)):
            self.commas[int(depth)] = self.commas.get(int(depth), 0) + int(n)
        opened = [(o, 0) for o in [*self.lists.values(), self.root] if o is not None and not o.closed]
        filled = np.flatnonzero(~np.isin(own, _SKIPPED))
        if self.root is not None and self.root.closed:
            self.root.behind += len(filled)
        self.filled += len(filled)
        if not self.first:
            if len(filled):
                self.first = int(own[filled[0]])
                if self.first == 91 and not inside:
                    self.root = Opening(self.size + int(filled[0]), 1)
                    opened.append((self.root, int(filled[0]) + 1))
        for m in _RECORDS_KEY.finditer(data):
            at = m.end() - 1
            if outside[at]:
                made = self.lists[int(deep[at])] = Opening(self.size + at, int(deep[at]))
                opened = [(o, s) for o, s in opened if o is self.root or o.depth != made.depth] + [(made, at + 1)]
        for o, start in opened:
            closing = np.flatnonzero(deep[start:] < o.depth)
            end = start + int(closing[0]) if len(closing) else len(own)
            o.closed = bool(len(closing))
            o.behind = int(np.count_nonzero(filled > end))
            o.commas += int(np.count_nonzero(comma[start:end] & (deep[start:end] == o.depth)))
        ends = np.flatnonzero(outside & (deep == 0) & ((own == 93) | (own == 125)))
        self.values += len(ends)
        self.breaks += int(np.count_nonzero(outside & (own == 10)))
        self.least = min(self.least, int(deep.min(initial=self.least)))
        self.odd, self.depth, self.size = bool(odd[-1]), int(deep[-1]), self.size + len(own)


@dataclass
class Start:
    """State at the start of a split: inside a string, depth, number of the record that is open; ``opens`` is the place of the list, if it opens here."""

    inside: bool
    depth: int
    level: int
    index: int
    opens: int | None


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", _END).text(paths).select(
        F.col(FILE_PATH).alias("source_id"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], bytes]]:
    """``((source, block, file size), bytes)`` in order; the reader gives the pieces of a split one after another."""
    for batch in batches:
        if not len(batch):
            continue
        source, block, size = (batch.column(c) for c in ("source_id", "block", "size"))
        blocks = block.to_numpy()
        codes = source.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
        values = batch.column("value").to_pylist()
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            yield (source[a].as_py(), int(blocks[a]), size[a].as_py()), _END.encode().join([*values[a:b], b""])


def summaries(pieces: DataFrame) -> dict[str, list[tuple[int, Summary, Summary, int]]]:
    """Both summaries of every split, by file and in order: one row per split, as many as the driver plans reads."""
    def run(batches):
        now, pair = None, (Summary(), Summary())

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([now[2]], pa.int64()),
                                               pa.array([pickle.dumps(pair)], pa.binary())], ["source_id", "block", "size", "pair"])

        for key, data in _runs(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, pair = key, (Summary(), Summary())
            own, odd = structure(data)
            for inside, summary in enumerate(pair):
                summary.read(data, own, odd, bool(inside))
        if now is not None:
            yield row()

    files: dict[str, list] = {}
    rows = pieces.mapInArrow(run, "source_id string, block bigint, size bigint, pair binary")
    for r in rows.collect():  # all splits at a time
        files.setdefault(r["source_id"], []).append((r["block"], *pickle.loads(r["pair"]), r["size"]))
    return {source: sorted(own, key=lambda x: x[0]) for source, own in files.items()}


def _starts(source: str, splits: list[tuple[int, Summary, Summary, int]]) -> dict[int, Start] | str:
    """State at the start of every split that holds records, or how else the file is to be read: ``lines`` or ``whole``."""
    chosen, inside, depth = [], False, 0
    for block, out, within, _ in splits:
        own = within if inside else out
        chosen.append((block, own, inside, depth))
        inside ^= own.odd
        depth += own.depth
    # The last piece of a file may or may not have ended with the bracket that the reader takes off;
    # the reader may also skip a byte order mark of three bytes.
    added = sum(own.size for _, own, _, _ in chosen) - splits[0][3] in (1, -2)
    depth += added
    if inside or depth:
        raise ValueError(f"not a whole JSON document: {source}")
    first = chosen[0][1]
    if first.first not in b"[{":
        return "lines" if sum(own.breaks for _, own, _, _ in chosen) > 1 else "whole"
    if first.values > 1:
        return "lines"
    lists = [(k, own.lists[2 - d]) for k, (_, own, _, d) in enumerate(chosen) if 2 - d in own.lists]
    if first.root is None and not lists:
        return "whole"
    k, opening = (0, first.root) if first.root is not None else lists[-1]
    level = chosen[k][3] + opening.depth
    starts = {chosen[k][0]: Start(chosen[k][2], chosen[k][3], level, 0, opening.at)}
    index, closed, behind = opening.commas, opening.closed, opening.behind
    for block, own, inside, depth in chosen[k + 1:]:
        if closed:
            behind += own.filled
            continue
        starts[block] = Start(inside, depth, level, index, None)
        index += own.commas.get(level - depth, 0)
        closed = own.least + depth < level
    if first.root is not None and behind > added:
        raise ValueError(f"text after the JSON document: {source}")
    return starts


def _items(starts: dict[tuple[str, int], Start], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, bool]]:
    """``(source, index, block, text, whole)`` of the list items of each split; an item that crosses its border is not whole."""
    now, start, text, at, deep_now, odd_now, index, whole, open_, done = None, None, [], 0, 0, False, 0, False, False, False
    for key, data in _runs(batches):
        if key != now:
            if open_ and not done and text:
                yield now[0], index, now[1], b"".join(text), False
            now, start = key, starts.get(key[:2])
            if start is not None:
                text, at, deep_now, odd_now, index = [], 0, start.depth, False, start.index
                open_, whole, done = start.opens is None, False, False
        if start is None or done:
            continue
        own, odd = structure(data)
        odd = odd ^ odd_now
        outside = odd == start.inside
        deep = depths(own, outside) + deep_now
        begin = 0
        if not open_ and start.opens < at + len(own):
            open_, whole, begin = True, True, start.opens - at + 1
        if open_:
            closing = np.flatnonzero(deep[begin:] < start.level)
            end = begin + int(closing[0]) if len(closing) else len(own)
            commas = np.flatnonzero(outside[begin:end] & (own[begin:end] == 44) & (deep[begin:end] == start.level)) + begin
            for c in commas.tolist():
                text.append(data[begin:c])
                yield now[0], index, now[1], b"".join(text), whole
                text, begin, whole, index = [], c + 1, True, index + 1
            text.append(data[begin:end])
            if len(closing):
                done = True
                # An empty list has one empty item.
                yield now[0], index, now[1], b"".join(text), whole
                text = []
        at, deep_now, odd_now = at + len(own), int(deep[-1]), bool(odd[-1])
    if start is not None and open_ and not done and text:
        yield now[0], index, now[1], b"".join(text), False


def large_documents(spark: SparkSession, paths: list[str], record) -> tuple[DataFrame | None, list[str], list[str]]:
    """Records of large JSON files, and the files that are JSON Lines or one value.

    ``record`` turns the text of one item into a record's text.  Records are
    ``source_id, record_index, units, content``.  The driver holds a few numbers
    per split.
    """
    pieces = _pieces(spark, paths)
    starts: dict[tuple[str, int], Start] = {}
    other: dict[str, list[str]] = {"lines": [], "whole": []}
    for source, splits in summaries(pieces).items():
        found = _starts(source, splits)
        if isinstance(found, str):
            other[found].append(source)
        else:
            starts.update({(source, block): s for block, s in found.items()})
    if not starts:
        return None, other["lines"], other["whole"]
    shared = spark.sparkContext.broadcast(starts)

    def batch_of(rows):
        source, index, block, content = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(index, pa.int64()), pa.array(block, pa.int64()),
                                           pa.array(content, pa.binary())], ["source_id", "record_index", "block", "content"])

    def run(whole: bool):
        def items(batches):
            held, size = [], 0
            for source, index, block, text, complete in _items(shared.value, batches):
                if complete != whole or whole and not index and not text.strip(_BLANK):
                    continue
                made = record(text).encode() if whole else text
                held.append((source, index, block, made))
                size += len(made)
                if len(held) >= 10_000 or size >= 4 << 20:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

        return items

    def join(batches):
        for batch in batches:
            rows = [(s, i, 0, record(b"".join(parts)).encode()) for s, i, parts in zip(*(batch.column(c).to_pylist() for c in (
                "source_id", "record_index", "parts"))) if i or b"".join(parts).strip(_BLANK)]
            if rows:
                yield batch_of(rows)

    columns = "source_id string, record_index bigint, block bigint, content binary"
    crossing = pieces.mapInArrow(run(False), columns).groupBy("source_id", "record_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "content"))), lambda p: p["content"]).alias("parts"))
    both = pieces.mapInArrow(run(True), columns).unionByName(crossing.mapInArrow(join, columns))
    records = both.select("source_id", "record_index", F.lit(1).cast("bigint").alias("units"), F.col("content").cast("string").alias("content"))
    return records, other["lines"], other["whole"]
