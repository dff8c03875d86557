"""Candidate families for exact set-similarity joins.

A text stands for the set of its word shingles.  Shingles are put in one global
order, rare ones first; two sets of Jaccard similarity of 0.75 or more share
one of their first ``n // 4 + 1`` shingles.  All texts that share such a
shingle with a common leader form a family: every link lies inside a family,
and families replace the pairs of a shingle, which are never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _mix, blocks, cut, partitions, raw_bytes, shingles, words

SHINGLE = 5
# Similarity of three quarters, as whole numbers: 4 * intersection >= 3 * union.
ABOVE, BELOW = 3, 4
# Buckets of the rarity sketch; its size does not depend on the data.
BITS = 22
BUCKETS = 1 << BITS
PIECES = 256
_SHIFT = np.uint64(64 - BITS)
# Members of a family that one task compares with each other.
FAMILY_BLOCK = 1024
# Sizes of sets are told apart in steps of a 32nd octave; those of similar sets are at most SPAN steps apart.
_STEPS = 2.0 ** (np.arange(40 * 32) / 32)
SPAN = 14
# Texts with a common shingle that are held against each other one by one; more are led by sizes.
LISTED = 64
# Packed postings: parts of the keys for each shuffle partition, and postings that a task holds at a time.
PARTS = 8
HELD = 1 << 18

# A source of sets: for a batch slice, the shingle hashes of its texts and where each text's begin.
Sets = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def similar(common: int, a: int, b: int) -> bool:
    return BELOW * common >= ABOVE * (a + b - common)


def least_common(a: int, b: int) -> int:
    """Least intersection of similar sets of these sizes."""
    return -(-ABOVE * (a + b) // (ABOVE + BELOW))


def text_shingles(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*words(*raw_bytes(part.column("_t"))), SHINGLE)


def rarity(docs: DataFrame, sets: Sets) -> np.ndarray:
    """How frequent each shingle bucket is over all rows, as the bit length of its count (at most 63).

    Every task counts into an array of fixed size; the arrays are added in
    pieces, so the sums are spread over tasks and read as a stream.
    """
    size = BUCKETS // PIECES

    def count(batches):
        total = np.zeros(BUCKETS, np.uint32)  # no task reads 2 ** 32 shingles
        for batch in batches:
            for part in blocks(batch, "_t", 2 << 20):
                values, _ = sets(part)
                np.add.at(total, (values >> _SHIFT).astype(np.int64), np.uint32(1))
        # Most counts of one task are small: a byte each, and the rest added as a short list.
        large = np.flatnonzero(total > 255)
        rest = np.searchsorted(large, np.arange(PIECES + 1) * size)
        rows = [(i, total[i * size:(i + 1) * size].clip(max=255).astype(np.uint8).tobytes(),
                 large[rest[i]:rest[i + 1]] - i * size, total[large[rest[i]:rest[i + 1]]].astype(np.int64) - 255) for i in range(PIECES)]
        piece, small, places, more = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(small, pa.binary()), pa.array(places, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))],
            ["piece", "small", "places", "more"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, piece in enumerate(batch.column("piece").to_pylist()):
                own = sums.setdefault(piece, np.zeros(size, np.int64))
                own += np.frombuffer(batch.column("small")[i].as_buffer(), np.uint8)
                own[np.array(batch.column("places")[i].as_py(), np.int64)] += np.array(batch.column("more")[i].as_py(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums.keys(), pa.int32()), pa.array([np.ceil(np.log2(s + 1)).astype(np.uint8).tobytes() for s in sums.values()], pa.binary())],
                ["piece", "classes"])

    spark = docs.sparkSession
    rows = docs.select("_t").mapInArrow(count, "piece int, small binary, places array<bigint>, more array<bigint>") \
        .repartition(min(PIECES, partitions(spark)), "piece").mapInArrow(add, "piece int, classes binary").collect()
    classes = np.zeros(BUCKETS, np.uint8)  # a fixed number of rows and bytes
    for r in rows:
        classes[r["piece"] * size:(r["piece"] + 1) * size] = np.frombuffer(r["classes"], np.uint8)
    return classes


def ordered_sets(values: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets without repeats, each in the global order (rarity class, then hash), and where each begins."""
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    rank = classes[(values >> _SHIFT).astype(np.int64)].astype(np.uint64)
    width = np.uint64(max(1, int(len(starts)).bit_length()))
    short = np.uint64(64 - 6) - width
    # Owner, class and the first bits of the hash in one number; where those bits are equal, the whole hash decides.
    key = (owner << (np.uint64(64) - width)) | (rank << short) | (values >> (np.uint64(64) - short))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if len(same) and np.any(values[order[same + 1]] != values[order[same]]):
        order = np.lexsort((values, rank, owner))
    owner, values = owner[order].astype(np.int64), values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(len(starts)))


def digests(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """112 bits for each set or list, whatever its order: 48, which name it in postings, and 64 more."""
    # The values are evenly spread hashes themselves.
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)]) for v in (_mix(values ^ np.uint64(0x5D1)), values)]
    first, second = (_mix(s[starts[1:]] - s[starts[:-1]]) for s in sums)
    return (first >> np.uint64(16)).view(np.int64), second.view(np.int64)


def taken(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``which`` (rising), and where each begins."""
    n = np.diff(starts)
    kept = np.zeros(len(n), bool)
    kept[which] = True
    return values[np.repeat(kept, n)], np.concatenate([[0], np.cumsum(n[which])])


def prefixes(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, shingle)`` of the first ``n // 4 + 1`` shingles of each set."""
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(values)) - starts[owner] <= n[owner] // 4
    # 48 bits of a hash are enough to bring sets together: a chance clash only makes a family larger.
    return owner[inside], (values[inside] & np.uint64(0xFFFFFFFFFFFF0000)).view(np.int64)


def families(postings: DataFrame, member: list[str]) -> DataFrame:
    """Leader and member of every family: ``l_<member>..., <member>...``, each pair once.

    ``postings`` has ``key`` and the member columns (integers).  The rows of a
    key are read in order as a stream: the first is the leader, and each later
    row gives one pair, so a key shared by many texts costs one row
    per text.  Keys that a single text has give nothing.
    """
    def lead(batches):
        last, leader = None, None
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column("key").to_numpy()
            own = [batch.column(c).to_numpy() for c in member]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            if last is not None and key[0] == last:
                first[0] = False
            at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            lead = [np.where(at >= 0, o[np.maximum(at, 0)], leader[i] if leader is not None else 0) for i, o in enumerate(own)]
            last, leader = key[-1], [x[-1] for x in lead]
            other = ~first & np.any([a != b for a, b in zip(lead, own)], axis=0)
            if other.any():
                pairs = np.unique(np.stack([*[x[other] for x in lead], *[x[other] for x in own]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], [*[f"l_{m}" for m in member], *member])

    columns = [*[f"l_{m}" for m in member], *member]
    return (
        postings.repartition(partitions(postings.sparkSession), "key").sortWithinPartitions("key", *member)
        .mapInArrow(lead, ", ".join(f"{c} bigint" for c in columns)).distinct()
    )


def size_step(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_STEPS, n, side="right") - 1


def sized_prefixes(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``prefixes`` whose shingles tell in the low 16 bits the size of their set and the largest size that it can match.

    If a set of ``n`` shares its shingle at place ``i`` with a set of ``m`` and none before, at most ``n - i`` are
    common, and sets of these sizes need three sevenths of ``n + m``.  So ``m`` has a limit, which falls from
    ``n * 4 // 3`` at the first place to ``n * 3 // 4`` at the last.
    """
    owner, keys = prefixes(values, starts)
    n = np.diff(starts)[owner]
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    at = np.arange(len(owner)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(owner) else owner
    size = size_step(n)
    reach = size_step((ABOVE + BELOW) * (n - at) // ABOVE - n) - size + SPAN
    return owner, keys | size // SPAN << 9 | size % SPAN << 5 | reach


def close_families(postings: DataFrame, member: str) -> DataFrame:
    """Leader and member of every family: ``l_<member>, <member>``, each pair once; two sets that may be similar are in one.

    ``postings`` has ``key`` (see ``sized_prefixes``) and ``member``.  Of a key's rows, up to ``LISTED`` are held against
    each other, and those stay that fit another one's size and place; the smallest member leads.  More rows are read as
    a stream in the order of their sizes, so whatever a key has, one row a batch and the leaders are held: the
    first row of each ``SPAN`` of sizes leads the rows of this span and the next one.
    """
    def lead(batches):
        def few(key: np.ndarray, own: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
            for n in np.unique(sizes[(sizes > 1) & (sizes <= LISTED)]):
                at = starts[sizes == n][:, None] + np.arange(n)
                code, ids = key[at], own[at]
                size = (code >> 9 & 127) * SPAN + (code >> 5 & 15)
                most = size + (code & 31) - SPAN
                fits = (size[:, None, :] <= most[:, :, None]) & (size[:, :, None] <= most[:, None, :])
                fits &= ids[:, None, :] != ids[:, :, None]
                kept = fits.any(2)
                leader = np.where(kept, ids, np.iinfo(np.int64).max).min(1, keepdims=True)
                kept &= ids != leader
                yield np.stack([np.broadcast_to(leader, ids.shape)[kept], ids[kept]])

        def many(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs, and which rows are the first of their span."""
            span = key >> 9
            first = np.ones(len(span), bool)
            first[1:] = span[1:] != span[:-1]
            heads = np.flatnonzero(first)
            each = np.cumsum(first) - 1
            lead, begun = own[heads], span[heads]
            after = np.zeros(len(heads), bool)
            after[1:] = (begun[1:] == begun[:-1] + 1) & (begun[1:] >> 7 == begun[:-1] >> 7)
            before = np.concatenate([lead[:1], lead[:-1]])
            rest = after[each]
            found = np.concatenate([np.stack([lead[each], own]), np.stack([before[each], own])[:, rest]], axis=1)
            return found[:, found[0] != found[1]], heads

        held_key = held_own = np.zeros(0, np.int64)
        streamed = None  # the key whose rows are read as a stream; its last two leaders are held
        for batch in batches:
            if not len(batch):
                continue
            key = np.concatenate([held_key, batch.column("key").to_numpy()])
            own = np.concatenate([held_own, batch.column(member).to_numpy()])
            name = key >> 16
            starts = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(key)))
            long = sizes > LISTED
            long[0] |= streamed is not None and name[0] == streamed
            found = []
            if long.any():
                rows = np.flatnonzero(np.repeat(long, sizes))
                pairs, heads = many(key[rows], own[rows])
                found.append(pairs)
            if long[-1]:
                streamed, last = name[-1], rows[heads[-2:]]
                last = last[name[last] == streamed]
            else:
                streamed, last = None, np.arange(starts[-1], len(key))
            found += few(key, own, starts[:-1], np.where(long, 0, sizes)[:-1])
            held_key, held_own = key[last], own[last]
            if any(f.shape[1] for f in found):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(found, axis=1), axis=1)], [f"l_{member}", member])
        if streamed is None and len(held_key):
            for f in few(held_key, held_own, np.zeros(1, np.int64), np.array([len(held_key)])):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(f, axis=1)], [f"l_{member}", member])

    return (
        postings.repartition(partitions(postings.sparkSession), F.shiftright("key", 16))
        .sortWithinPartitions(F.shiftright("key", 9), member).mapInArrow(lead, f"l_{member} bigint, {member} bigint").distinct()
    )


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit values of a column of packed lists, one list after another, and where each begins (one more for the end)."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data[ends[0]:ends[-1]] if data is not None else b"", np.uint64), (ends - ends[0]) // 8


def packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of 64-bit values as a column of bytes (see ``lists``)."""
    ends = pa.py_buffer((starts * 8).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, ends, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def packed_postings(postings: DataFrame, member: str) -> DataFrame:
    """``part, posts``: many postings a row, as pairs of key and member, of one part of the keys.

    ``postings`` has ``member`` and its keys as one packed list; keys are evenly spread hashes.
    """
    parts = PARTS * partitions(postings.sparkSession)

    def pack(batches):
        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            posts = np.concatenate(held)
            part = (posts[:, 0].view(np.uint64) >> np.uint64(16)) % np.uint64(parts)
            order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
            counts = np.bincount(part.astype(np.int64), minlength=parts)
            used = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), packed(posts[order], 2 * np.concatenate([[0], np.cumsum(counts[used])]))], ["part", "posts"])

        held, n = [], 0
        for batch in batches:
            keys, starts = lists(batch.column("keys"))
            held.append(np.stack([keys.view(np.int64), np.repeat(batch.column(member).to_numpy(), np.diff(starts))], axis=1))
            n += len(keys)
            if n >= HELD:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return postings.mapInArrow(pack, "part int, posts binary")


def packed_families(posts: DataFrame, member: str) -> DataFrame:
    """``families`` of one member column, from packed postings.

    A task holds one posting per key of a part and about ``HELD`` more, however many members share a key.
    """
    def lead(batches):
        def pairs(held: list[np.ndarray], led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Leader and other members of the keys held, and each key's leader; ``led`` has those known before."""
            posts = np.concatenate([led, *held])
            order = np.argsort(posts[:, 0], kind="stable")
            same = np.zeros(len(order) + 1, bool)
            same[1:-1] = posts[order[1:], 0] == posts[order[:-1], 0]
            alone, shared = order[~(same[1:] | same[:-1])], order[same[1:] | same[:-1]]
            # Among the postings of a key, one that led before comes first, then the smallest member.
            shared = shared[np.lexsort((posts[shared, 1], shared >= len(led), posts[shared, 0]))]
            key, own = posts[shared].T
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            leader = own[first][np.cumsum(first) - 1]
            found = np.stack([leader, own])[:, leader != own]
            return np.unique(found, axis=1), posts[np.concatenate([alone, shared[first]])]

        none = np.zeros((0, 2), np.int64)
        held, led, n, last = [], none, 0, -1
        for batch in batches:
            values, starts = lists(batch.column("posts"))
            for i, part in enumerate(batch.column("part").to_pylist()):
                if held and (part != last or n >= HELD):
                    found, led = pairs(held, led)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], [f"l_{member}", member])
                    held, n = [], 0
                if part != last:
                    led, last = none, part
                held.append(values[starts[i]:starts[i + 1]].view(np.int64).reshape(-1, 2))
                n += len(held[-1])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs(held, led)[0]], [f"l_{member}", member])

    return (
        posts.repartition(partitions(posts.sparkSession), "part").sortWithinPartitions("part", "posts")
        .mapInArrow(lead, f"l_{member} bigint, {member} bigint").distinct()
    )


def with_leaders(pairs: DataFrame, member: list[str]) -> DataFrame:
    """The pairs, with each leader as a member of its own family; the pairs are written once."""
    pairs = cut(pairs, "families")
    lead = [f"l_{m}" for m in member]
    own = pairs.select(*lead).distinct()
    return pairs.unionByName(own.select(*lead, *[F.col(f"l_{m}").alias(m) for m in member]))


def dealt(pairs: DataFrame, member: list[str]) -> DataFrame:
    """The pairs with ``_b``, the block of each member, and ``_nb``, the number of blocks of the family.

    Members go to blocks by a hash, so a block has about ``FAMILY_BLOCK``
    members however large the family is.
    """
    lead = [f"l_{m}" for m in member]
    sizes = pairs.groupBy(*lead).agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("_nb"))
    return pairs.join(sizes, lead).withColumn("_b", F.pmod(F.xxhash64(*member), F.col("_nb")).cast("int"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows cut between groups of equal ``keys``, and where each group begins (one more for the end).

    Many groups come together; beside a batch only a group that goes on after it is held.
    """
    held: list[pa.RecordBatch] = []

    def joined(last: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches([*held, *last]).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(k)[len(held[-1]) - 1].as_py() != c[0] for k, c in zip(keys, columns)):
            change = np.concatenate([[0], change])
        if not len(change):
            held.append(batch)
            continue
        before = sum(map(len, held))
        yield joined([batch.slice(0, change[-1])]), np.concatenate([[0], before + change])
        held = [batch.slice(change[-1])]
    if held:
        yield joined([]), np.array([0, sum(map(len, held))])


def each_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Groups of rows that follow each other with equal ``keys``; one group is held at a time."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(k)[len(held[-1]) - 1].as_py() != c[0] for k, c in zip(keys, columns)):
            yield joined()
            held = []
        cuts = [0, *change.tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(batch):
                yield joined()
                held = []
    if held:
        yield joined()
