"""Near duplicates: an exact Jaccard join on word shingles with signature trees.

Families (see ``families``) say which texts may be linked.  Inside a family the
texts are leaves of a tree whose nodes hold the union of the leaves' token
bitmaps and the range of their sizes.  The tree is joined with itself by a dual
traversal that leaves out node pairs whose largest possible overlap is too
small, and those whose leaves are already connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import lookup_join
from .common import blocks, cut, drop, partitions, shuffles_removed, table
from .components import components
from .families import (ABOVE, BELOW, Sets, close_families, dealt, digests, each_group, least_common, ordered_sets, rarity,
                       similar, sized_prefixes, taken, text_shingles, with_leaders)

FANOUT = 6
# Identifiers that select texts are broadcast up to this many; beyond, texts and identifiers meet by shuffle.
BROADCAST_IDS = 500_000


class Node:
    """A node of the tree: the union of its leaves' bitmaps at two widths, size range, and children or one leaf.

    ``lost`` is the largest number of tokens that any leaf loses because they
    share a bit, at each width.  ``done`` says that nothing new can come from
    pairs of the node's own leaves.
    """

    __slots__ = ("width", "bits", "half", "lost", "half_lost", "low", "high", "children", "leaf", "done")

    def __init__(self, leaf: int, width: int, bits: int, size: int) -> None:
        self.leaf, self.width, self.bits, self.low, self.high = leaf, width, bits, size, size
        self.half = (bits | bits >> width // 2) & ((1 << width // 2) - 1)
        self.lost, self.half_lost = size - bits.bit_count(), size - self.half.bit_count()
        self.children, self.done = [], False

    @classmethod
    def over(cls, children: list[Node]) -> Node:
        made = cls(-1, min(c.width for c in children), 0, 0)
        made.children = children
        made.low, made.high = min(c.low for c in children), max(c.high for c in children)
        made.lost = made.half_lost = 0
        for c in children:
            # Children of twice the width are folded; of more, they would say nothing: every bit is set.
            bits, lost = (c.bits, c.lost) if c.width == made.width else (c.half, c.half_lost) if c.width == 2 * made.width \
                else ((1 << made.width) - 1, c.high)
            made.bits |= bits
            made.half |= (bits | bits >> made.width // 2) & ((1 << made.width // 2) - 1)
            made.lost = max(made.lost, lost)
            made.half_lost = max(made.half_lost, c.half_lost if c.width == made.width else c.high)
        return made


def bitmap(tokens: np.ndarray) -> tuple[int, int]:
    """``(width, bits)``: a bit for every token, in at least twice as many bits as tokens."""
    width = 128
    while width < 2 * len(tokens):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(tokens >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return width, int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def may_overlap(a: Node, b: Node) -> bool:
    """Whether some leaf of ``a`` and some leaf of ``b`` can be similar, by sizes and largest possible overlap."""
    if BELOW * a.high < ABOVE * b.low or BELOW * b.high < ABOVE * a.low:
        return False
    if a.width == b.width:
        most = (a.bits & b.bits).bit_count() + min(a.lost, b.lost)
    elif a.width == 2 * b.width:
        most = (a.half & b.bits).bit_count() + min(a.half_lost, b.lost)
    elif b.width == 2 * a.width:
        most = (a.bits & b.half).bit_count() + min(a.lost, b.half_lost)
    else:
        return True
    return most >= least_common(a.low, b.low)


def build(leaves: list[Node]) -> Node:
    """A tree over some leaves, similar sizes side by side."""
    level = sorted(leaves, key=lambda n: (n.low, n.leaf))
    while len(level) > 1:
        level = [Node.over(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def traverse(a: Node, b: Node, settled, meet) -> None:
    """Dual traversal: ``meet(leaf, leaf)`` for pairs of leaves that may overlap, unless ``settled(node, node)``."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a is b and a.leaf >= 0 or not may_overlap(a, b) or settled(a, b):
            continue
        if a.leaf >= 0 and b.leaf >= 0:
            meet(a.leaf, b.leaf)
        elif a is b:
            stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
        elif b.leaf >= 0 or a.leaf < 0 and a.high - a.low >= b.high - b.low:
            stack += [(x, b) for x in a.children]
        else:
            stack += [(a, y) for y in b.children]


def with_candidates(leaves: list[Node], side: np.ndarray) -> np.ndarray:
    """Which of the leaves may be similar to one of the other side (to any other if there is one side), by their bitmaps alone."""
    found = np.zeros(len(leaves), bool)

    def all_found(node: Node) -> bool:
        if not node.done:
            node.done = bool(found[node.leaf]) if node.leaf >= 0 else all(map(all_found, node.children))
        return node.done

    def meet(x: int, y: int) -> None:
        found[[x, y]] = True

    roots = [build([n for n in leaves if side[n.leaf] == s]) for s in np.unique(side)]
    traverse(roots[0], roots[-1], lambda a, b: all_found(a) and all_found(b), meet)
    return found


class SignatureTree:
    """Links between sets, found by dual traversal; pairs that are connected already are left out."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.links = sets, []
        self.root_of = list(range(len(sets)))
        self.leaves = [Node(i, *bitmap(s), len(s)) for i, s in enumerate(sets)]

    def find(self, i: int) -> int:
        while self.root_of[i] != i:
            self.root_of[i] = self.root_of[self.root_of[i]]
            i = self.root_of[i]
        return i

    def build(self, which: list[int]) -> Node:
        return build([self.leaves[i] for i in which])

    def _component(self, node: Node) -> int:
        """The component of all leaves of a node, or -1 if they have several."""
        if not node.done and node.leaf < 0:
            roots = {self._component(c) for c in node.children}
            node.done = len(roots) == 1 and -1 not in roots
            if not node.done:
                return -1
        while node.leaf < 0:
            node = node.children[0]
        return self.find(node.leaf)

    def _connected(self, a: Node, b: Node) -> bool:
        root = self._component(a)
        return root >= 0 and root == self._component(b)

    def _meet(self, i: int, j: int) -> None:
        x, y = self.sets[i], self.sets[j]
        if similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
            self.links.append((i, j))
            self.root_of[self.find(j)] = self.find(i)

    def join(self, a: Node, b: Node) -> None:
        """Link all similar leaves of two nodes, unless they are connected already."""
        traverse(a, b, self._connected, self._meet)


def narrow(docs: DataFrame, sets: Sets, classes: np.ndarray) -> DataFrame:
    """``_id, n, d1, d2, bits``: size, digest and bitmap of every row's set."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "_t"):
                values, starts = ordered_sets(*sets(part), shared.value)
                d1, d2 = digests(values, starts)
                bits = []
                for a, b in zip(starts, starts[1:]):
                    width, own = bitmap(values[a:b])
                    bits.append(own.to_bytes(width // 8, "little"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(np.diff(starts)), pa.array(d1), pa.array(d2), pa.array(bits, pa.binary())],
                    ["_id", "n", "d1", "d2", "bits"])

    return docs.mapInArrow(run, "_id bigint, n bigint, d1 bigint, d2 bigint, bits binary")


def postings(docs: DataFrame, sets: Sets, classes: np.ndarray) -> DataFrame:
    """``key, _id``: the prefix shingles of the sets, with sizes and places; equal sets of a block are posted once, for the smallest identifier."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "_t", 4 << 20):
                values, starts = sets(part)
                # Equal lists of shingles are known before they are put in order.
                ids = part.column("_id").to_numpy()
                rising = np.argsort(ids, kind="stable")
                which = np.sort(rising[np.unique(np.stack(digests(values, starts))[:, rising], axis=1, return_index=True)[1]])
                owner, keys = sized_prefixes(*ordered_sets(*taken(values, starts, which), shared.value))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[which[owner]])], ["key", "_id"])

    return docs.mapInArrow(run, "key bigint, _id bigint")


def promising(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """``l__id, _id``: the members of each dealt family that may be similar to another one, by bitmaps alone.

    Bitmaps are a small part of the sets, and most members of a family share
    too little with any other; only the rest is compared whole.  Every block
    of a family meets itself and every other block.
    """
    def run(batches):
        for group in each_group(batches, ["l__id", "_i", "_j"]):
            side = group.column("_b").to_numpy()
            if len(group) < 2 or side[0] == side[-1] and group.column("_i")[0] != group.column("_j")[0]:
                continue
            leaves = [Node(i, 8 * len(b), int.from_bytes(b, "little"), n) for i, (b, n) in enumerate(
                zip(group.column("bits").to_pylist(), group.column("n").to_pylist()))]
            found = pa.array(with_candidates(leaves, side))
            yield pa.RecordBatch.from_arrays([group.column(c).filter(found) for c in ("l__id", "_id")], ["l__id", "_id"])

    # Bitmaps are joined once and copied to the blocks by the tasks that send them.
    known = pairs.join(bits, "_id").select("l__id", "_id", "_nb", "_b", "n", "bits")
    met = known.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).select(
        "l__id", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "_id", "n", "bits")
    return met.repartition(partitions(pairs.sparkSession), "l__id", "_i", "_j").sortWithinPartitions("l__id", "_i", "_j", "_b", "_id") \
        .mapInArrow(run, "l__id bigint, _id bigint").distinct()


def fetch(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``docs`` whose ``_id`` is among ``ids``; rows are shuffled only if the identifiers are too many to broadcast."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "_id", how)


def _numbered(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("set")]


def family_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v``: links inside families, enough to connect all that are connected.

    ``pairs`` are the dealt families, ``sets`` has ``_id, set`` (the shingles
    as packed 64-bit numbers).
    Families above one block are joined in two steps: every block by itself
    together with the leader, then those not connected to the leader with the
    other blocks.  Near copies of one text connect in the first step, so the
    second is small unless a family has many unrelated members.
    """
    parts = partitions(pairs.sparkSession)
    several = pairs.filter("_nb > 1").limit(1).count() > 0
    # Only families of several blocks are read again.
    # Sets go to their families straight from the tasks that make them, if the pairs are few.
    few = pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    both = sets.join(F.broadcast(pairs), "_id") if few else pairs.join(sets, "_id")
    placed = cut(both, "families") if several else both
    is_leader = F.col("_id") == F.col("l__id")
    # The leader takes part in every block.
    first = placed.withColumn("_b", F.explode(F.when(
        is_leader, F.sequence(F.lit(0), F.col("_nb") - 1)).otherwise(F.array("_b")))) if several else placed

    def inside(batches):
        for group in each_group(batches, ["l__id", "_b"]):
            ids = group.column("_id").to_numpy()
            tree = SignatureTree(_numbered(group))
            everything = tree.build(list(range(len(ids))))
            tree.join(everything, everything)
            lead = np.flatnonzero(ids == group.column("l__id").to_numpy()[0])
            with_leader = {tree.find(int(i)) for i in lead}  # a leader without a candidate is not there
            far = np.array([tree.find(i) not in with_leader for i in range(len(ids))])
            far &= group.column("_nb").to_numpy() > 1
            u = [ids[a] for a, _ in tree.links] + [i for i, f in zip(ids, far) if f]
            v = [ids[b] for _, b in tree.links] + [i for i, f in zip(ids, far) if f]
            n = len(u)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(group.column("l__id").to_pylist()[:1] * n, pa.int64())],
                ["u", "v", "l__id"])

    found = cut(first.repartition(parts, "l__id", "_b").sortWithinPartitions("l__id", "_b", "_id").mapInArrow(
        inside, "u bigint, v bigint, l__id bigint"), "links")
    links = found.filter("u != v").select("u", "v")
    if not several:
        return links
    # Second step: each unconnected member against the other blocks of its family.
    far = found.filter("u = v").select("l__id", F.col("u").alias("_id")).distinct()
    asking = placed.join(far, ["l__id", "_id"]).withColumn("_i", F.col("_b")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).filter("_i != _j").withColumn("_asks", F.lit(True))
    needed = asking.select("l__id", "_i").distinct()
    asked = placed.filter("_nb > 1").withColumn("_j", F.col("_b")).join(needed, "l__id").filter("_i != _j") \
        .withColumn("_asks", F.lit(False))
    columns = ["l__id", "_i", "_j", "_id", "set", "_asks"]

    def across(batches):
        for group in each_group(batches, ["l__id", "_i", "_j"]):
            ids, asks = group.column("_id").to_numpy(), group.column("_asks").to_numpy(zero_copy_only=False)
            if asks.all() or not asks.any():
                continue
            tree = SignatureTree(_numbered(group))
            tree.join(tree.build(np.flatnonzero(asks).tolist()), tree.build(np.flatnonzero(~asks).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[a] for a, _ in tree.links], pa.int64()), pa.array([ids[b] for _, b in tree.links], pa.int64())], ["u", "v"])

    second = asking.select(columns).unionByName(asked.select(columns)).repartition(parts, "l__id", "_i", "_j") \
        .sortWithinPartitions("l__id", "_i", "_j", "_id").mapInArrow(across, "u bigint, v bigint")
    return links.unionByName(second)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id``: one row per row of ``docs``.

    Words are lower-cased (A-Z); a text's set holds its distinct five-word
    shingles, or its whole word sequence if shorter.  Texts link when four
    times the intersection is at least three times the union;
    ``component_id`` is the smallest identifier reachable by links.  Null
    texts and texts without words have an empty set and link with nothing.
    Rows that share an identifier share a component.  A row without
    identifier has no component and links nothing.  Shingles and sets are
    compared by 64-bit hashes.
    """
    with shuffles_removed(docs.sparkSession):
        named, group = _grouped(docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")))
    return named.join(group.withColumnRenamed("node", "_id"), "_id", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"))


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_id, n, _rep`` of every row, and the ``node, component`` of those that are linked; what lies between is written and removed."""
    sets: Sets = text_shingles
    classes = rarity(rows, sets)
    own = cut(narrow(rows, sets, classes), "sets")
    filled = own.filter("n > 0 and _id is not null")
    equal = filled.groupBy("d1", "d2").agg(F.min("_id").alias("_rep"), F.max("_id").alias("_last")) \
        .filter("_rep != _last").select("d1", "d2", "_rep")
    named = cut(lookup_join(own, equal, ["d1", "d2"], F.xxhash64("_id"), "left", 64).select(
        "_id", "n", F.when((F.col("n") > 0) & F.col("_rep").isNotNull(), F.col("_rep")).otherwise(F.col("_id")).alias("_rep")), "copies")

    known = rows.filter(F.col("_id").isNotNull())
    # A copy posts what the smallest of its equals posts, so that one is in all its families (and leads some): it stands
    # for the others.  An identifier stays if any of its rows is the smallest of its equals.
    standing = F.bool_or(F.col("_id") == F.col("_rep"))
    stood_for = named.filter("_id is not null").groupBy("_id").agg(standing.alias("_own")).filter("not _own").select("_id")
    found = with_leaders(fetch(close_families(postings(known, sets, classes), "_id"), stood_for, "left_anti"), ["_id"])
    placed = cut(dealt(found, ["_id"]), "pairs")
    drop(found)
    # Rows that share an identifier have a bitmap each.
    near = cut(promising(placed, filled.select("_id", "n", "bits")), "promising")
    drop(placed)
    drop(own)
    # What is left of a family is dealt anew, to fewer blocks.
    pairs = cut(dealt(near, ["_id"]), "near")
    drop(near)
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def pack(batches):
        for batch in batches:
            for part in blocks(batch, "_t"):
                values, starts = ordered_sets(*sets(part), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(
                    [values[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], ["_id", "set"])

    packed = fetch(known, pairs.select("_id").distinct()).mapInArrow(pack, "_id bigint, set binary")
    links = family_links(pairs, packed)
    # Copies stand for each other: links are followed between representatives.
    copies = named.filter("_id != _rep").select(F.col("_id").alias("u"), F.col("_rep").alias("v"))
    return named, components(links.unionByName(copies))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(table(spark, folder, "documents"))
