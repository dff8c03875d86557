"""Byte-level BPE with a fixed public vocabulary: texts to ids and back.

Two tiers: a minimal perfect hash finds pre-tokens that are vocabulary entries
as a whole; all others are merged by a heap over linked bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from heapq import heapify
from heapq import heappop as pop
from heapq import heappush as push

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table

# Pre-tokens a worker remembers, twice over; beyond it forgets the older half, so its memory is bounded.
REMEMBERED = 200_000
# Bytes of text that are encoded at once.  Distinct stretches recur in larger blocks, but meanwhile a worker
# holds about 25 times as much.
ENCODED = 2 << 20
# Longer pre-tokens are worked out each time and not remembered.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash of a fixed key set (hash and displace).

    Keys are dealt to buckets; buckets, largest first, look for a displacement
    that sends all their keys to free slots, and buckets of one key are given a
    free slot outright (a negative displacement).  The table has as many slots
    as keys; a stored key tells members from others.
    """

    def __init__(self, keys: dict[bytes, int], load: int = 2) -> None:
        n = max(1, len(keys))
        self.slots: list[bytes | None] = [None] * n
        self.values = [0] * n
        self.shift = [0] * max(1, n // load)
        buckets: dict[int, list[tuple[bytes, int]]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % len(self.shift), []).append((key, h))
        single = []
        for b, own in sorted(buckets.items(), key=lambda kv: (-len(kv[1]), kv[0])):
            if len(own) == 1:
                single.append((b, own[0][0]))
                continue
            d = 0
            while True:
                places = {self._place(h, d) for _, h in own}
                if len(places) == len(own) and all(self.slots[p] is None for p in places):
                    break
                d += 1
            self.shift[b] = d
            for key, h in own:
                self._put(self._place(h, d), key, keys[key])
        free = [p for p, key in enumerate(self.slots) if key is None]
        for (b, key), p in zip(single, free):
            self.shift[b] = -1 - p
            self._put(p, key, keys[key])

    def _put(self, p: int, key: bytes, value: int) -> None:
        self.slots[p], self.values[p] = key, value

    def _place(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 20) % len(self.slots)

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        p = self._place(h, self.shift[h % len(self.shift)])
        return self.values[p] if self.slots[p] == key else None


def merge(piece: bytes, rank_of: Callable[[bytes], int | None], pairs: list[int | None]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair is joined first, the leftmost of equals.

    The bytes are a linked list of parts given by their starts; the heap holds
    candidate joins (rank, start and end in one integer) and stale ones are
    passed over, so a long pre-token takes ``n log n`` steps.  ``pairs`` has
    the rank of every pair of bytes.
    """
    n = len(piece)
    bits = 8 if n < 256 else n.bit_length()
    mask, two = (1 << bits) - 1, 2 * bits
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    # An entry is rank, start, end; one step to the right adds one to start and to end.
    step, at, heap = (1 << bits) + 1, 2, []
    left = piece[0]
    for right in piece[1:]:
        rank = pairs[left << 8 | right]
        if rank is not None:
            heap.append((rank << two) + at)
        left = right
        at += step
    heapify(heap)
    while heap:
        top = pop(heap)
        end = top & mask
        i = top >> bits & mask
        j = after[i]
        if j < 0 or j >= n or after[j] != end:  # a part is no longer there; one that was joined has after -1
            continue
        after[i] = end
        after[j] = -1
        if end < n:
            before[end] = i
            right = after[end]
            rank = rank_of(piece[i:right])
            if rank is not None:
                push(heap, rank << two | i << bits | right)
        if i:
            left = before[i]
            rank = rank_of(piece[left:end])
            if rank is not None:
                push(heap, rank << two | left << bits | end)
    ids, i = [], 0
    while i < n:
        j = after[i]
        ids.append(rank_of(piece[i:j]))
        i = j
    return ids


# A space next to other white space: there the pattern looks beyond the space.
_BLANK = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"
_TOUCHING = f"{_BLANK} | {_BLANK}"


class Encoder:
    """Encodes a block of texts to 32-bit ids.

    Where every space stands alone between other characters, the pattern never
    joins what a space separates.  Such texts are cut at their spaces, and each
    distinct stretch of the block (with its space in front) is encoded once.
    """

    def __init__(self, vocabulary: PerfectHash, pattern: str) -> None:
        self.split = regex.compile(pattern).findall
        self.cuts = pattern == public_vocabulary()[1]
        self.find = vocabulary.get
        self.rank_of = dict(zip(vocabulary.slots, vocabulary.values)).get
        self.pairs = [self.rank_of(bytes((a, b))) for a in range(256) for b in range(256)]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _token(self, token: str) -> bytes:
        packed = self.before.get(token)
        if packed is None:
            piece = token.encode("utf-8", "surrogatepass")
            whole = self.find(piece)
            ids = [whole] if whole is not None else merge(piece, self.rank_of, self.pairs)
            if None in ids:
                raise ValueError("the vocabulary lacks a single byte")
            packed = array("i", ids).tobytes()
        if len(token) <= SHORT:
            if len(self.known) >= REMEMBERED:  # the older half goes, and what is met again is kept
                self.before, self.known = self.known, {}
            self.known[token] = packed
        return packed

    def text(self, text: str) -> bytes:
        """Packed ids of one text."""
        known, own = self.known.get, self._token
        return b"".join([known(t) or own(t) for t in self.split(text)])

    def block(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; ``texts`` has no nulls."""
        texts = texts.cast(pa.large_string())
        # The rules for cutting at spaces are those of the public pattern; any other sees whole texts.
        whole = pc.match_substring_regex(texts, _TOUCHING if self.cuts else "")
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        starts = cut.offsets.to_numpy()
        stretches = cut.flatten().dictionary_encode()
        known, own, text = self.known.get, self._token, self.text
        packed = [(known(t := " " + r) or own(t)) if r.isalpha() else text(" " + r) for r in stretches.dictionary.to_pylist()]
        # The first stretch of a text has no space in front; a text that cannot be cut is one stretch.
        firsts = pc.if_else(whole, texts, pc.list_element(cut, 0)).to_pylist() if len(texts) else []
        codes = stretches.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes[starts[:-1]] = len(packed) + np.arange(len(texts))
        packed += [text(t) for t in firsts]
        sizes = np.array([len(p) for p in packed], np.int64) // 4
        table = pa.LargeListArray.from_arrays(
            np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[starts - starts[0]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(pa.array(codes)).flatten())


_READY: dict = {}


def _encoder(shared, name: str, pattern: str) -> Encoder:
    """The worker's encoder, with what it remembers, kept between tasks of one vocabulary."""
    if (name, pattern) not in _READY:
        _READY.clear()
        _READY[name, pattern] = Encoder(shared.value, pattern)
    return _READY[name, pattern]


def _name(ranks: dict[bytes, int]) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join(t + b"%d" % r for t, r in sorted(ranks.items())))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the ids of every whole text in ``ids`` (``array<int>``); null counts as empty.

    The vocabulary file is read on the driver and broadcast: its size is fixed.
    Nothing is shuffled; an existing ``ids`` column is replaced.
    """
    ranks = read_ranks(path)
    name = _name(ranks)
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash(ranks))
    rest = docs.drop("ids")

    def run(batches):
        encoder = _encoder(shared, name, pattern)
        for batch in batches:
            for part in blocks(batch, text_col, ENCODED):
                ids = encoder.block(part.column(text_col).fill_null(""))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return rest.mapInArrow(run, rest.select("*", F.array(F.lit(0)).alias("ids")).schema)


def _tokens_by_rank(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decoded(vocabulary: pa.Array, lists: pa.ListArray) -> pa.Array:
    """Bytes of each list of ids: tokens taken in a row already stand one after another."""
    flat = vocabulary.take(lists.flatten())
    ends = np.frombuffer(flat.buffers()[1], np.int32)[:len(flat) + 1]
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = ends[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
    valid = pc.cast(lists.is_valid(), pa.bool_()).buffers()[1] if lists.null_count else None
    return pa.Array.from_buffers(pa.binary(), len(lists), [valid, pa.py_buffer(np.ascontiguousarray(starts)), flat.buffers()[2]])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the bytes of the ids in ``decoded``; null ids give null, unknown ids fail."""
    shared = encoded.sparkSession.sparkContext.broadcast(_tokens_by_rank(path))
    rest = encoded.drop("decoded")

    def run(batches):
        vocabulary = pa.array(shared.value, pa.binary())
        for batch in batches:
            step = max(1, (1 << 20) * len(batch) // (1 + len(batch.column(ids_col).flatten())))
            for at in range(0, len(batch), step):
                part = pa.ipc.read_record_batch(batch.slice(at, step).serialize(), batch.schema)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, decoded(vocabulary, part.column(ids_col))], [*part.schema.names, "decoded"])

    return rest.mapInArrow(run, rest.select("*", F.lit(b"").alias("decoded")).schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with its ``ids`` and the bytes ``decoded`` from them, in one pass over the texts.

    As ``encode`` and ``decode`` one after the other, but one worker does both
    and the texts do not leave it again.
    """
    ranks = read_ranks(path)
    name = _name(ranks)
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash(ranks))
    tokens = docs.sparkSession.sparkContext.broadcast(_tokens_by_rank(path))
    rest = docs.drop("ids", "decoded")
    kept = [c for c in rest.columns if c != text_col]

    def run(batches):
        encoder, vocabulary = _encoder(shared, name, pattern), pa.array(tokens.value, pa.binary())
        for batch in batches:
            for part in blocks(batch, text_col, ENCODED):
                ids = encoder.block(part.column(text_col).fill_null(""))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], ids, decoded(vocabulary, ids)], [*kept, "ids", "decoded"])

    return rest.mapInArrow(run, rest.select(*kept, F.array(F.lit(0)).alias("ids"), F.lit(b"").alias("decoded")).schema)


def public_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the vocabulary that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all document texts, and the texts decoded from them, as digests."""
    path, pattern = public_vocabulary()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return round_trip(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
