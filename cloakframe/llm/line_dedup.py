"""Near-duplicate lines: an exact set-similarity join that removes later matches.

The tokens of a line are its five-word shingles; a shorter line is one token.
They are put in order of rarity; the prefix filter brings lines that may match into one family, where
positional and length filters leave few pairs to verify.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import BROADCAST_BYTES
from .common import blocks, cut, partitions, raw_bytes, shingles, table, unused, words
from .families import (ABOVE, BELOW, SHINGLE, dealt, digests, each_group, least_common, lists, ordered_sets, packed,
                       packed_families, packed_postings, prefixes, rarity, similar, taken, whole_groups, with_leaders)

LAST = (1 << 63) - 1
# Places of family lines are broadcast up to this many (five numbers each); beyond, they meet the lines by shuffle.
BROADCAST_LINES = 500_000
# Families of up to this many members are looked through together; of such a lot, prefixes times members are this many.
SMALL = 32
LOT = 1 << 20


def line_ends(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, line ends in them (one more entry at the front), and each line's text and number in it."""
    data, ends = raw_bytes(part.column("_t"))
    cuts = np.unique(np.concatenate([ends, np.flatnonzero(data == 10) + 1]))
    owner = np.searchsorted(ends, cuts[:-1], side="right") - 1
    first = np.searchsorted(owner, np.arange(len(ends)))
    return data, cuts, owner, np.arange(len(owner)) - first[owner] if len(owner) else owner


def line_sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of every line; all words of a line of fewer than five are its one shingle, and lines without words have none."""
    data, cuts, _, _ = line_ends(part)
    return shingles(*words(data, cuts), SHINGLE)


def line_table(rows: DataFrame, classes: np.ndarray) -> DataFrame:
    """``_id, _h, line, d1, d2, keys``: place and digest of every line that has shingles, and its prefix shingles.

    The digest is over the shingles as they come, repeats counted, so equal
    lines are known before they are put in order.  A line that a task meets
    again has its prefix once; the others' ``keys``, a packed list, are empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        met = np.zeros(0, np.int64)  # first digests of this task's lines, eight bytes each
        for batch in batches:
            for part in blocks(batch, "_t", 2 << 20):
                _, _, owner, number = line_ends(part)
                values, starts = line_sets(part)
                d1, d2 = digests(values, starts)
                at = np.flatnonzero(np.diff(starts))
                # Half a digest that was met is taken for the line: a clash only leaves prefixes to one of two, which 48 bits make
                # rarer than a fault of the machine; classes are kept apart by the whole digest.
                own, first = np.unique(d1[at], return_index=True)
                new = first[~np.isin(own, met, assume_unique=True)]
                met = np.union1d(met, own)
                which = np.sort(at[new])
                line, keys = prefixes(*ordered_sets(*taken(values, starts, which), shared.value))
                sizes = np.zeros(len(d1), np.int64)
                sizes[which] = np.bincount(line, minlength=len(which))
                texts = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(texts), part.column("_h").take(texts), pa.array(number[at]), pa.array(d1[at]), pa.array(d2[at]),
                     packed(keys, np.concatenate([[0], np.cumsum(sizes[at])]))], ["_id", "_h", "line", "d1", "d2", "keys"])

    return rows.mapInArrow(run, "_id bigint, _h bigint, line bigint, d1 bigint, d2 bigint, keys binary")


def packed_lines(rows: DataFrame, classes: np.ndarray) -> DataFrame:
    """``_id, _h, line, set`` of the lines that ``_wanted`` numbers, in the order of rarity."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "_t"):
                _, _, owner, number = line_ends(part)
                values, starts = line_sets(part)
                wanted = part.column("_wanted")
                asked = np.repeat(np.arange(len(part)), wanted.value_lengths().to_numpy()) * (1 << 32) + wanted.flatten().to_numpy()
                which = np.flatnonzero(np.isin(owner * (1 << 32) + number, asked))
                values, starts = ordered_sets(*taken(values, starts, which), shared.value)
                texts = pa.array(owner[which])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(texts), part.column("_h").take(texts), pa.array(number[which]),
                     packed(values, starts)], ["_id", "_h", "line", "set"])

    return rows.mapInArrow(run, "_id bigint, _h bigint, line bigint, set binary")


def earlier_matches(sets: list[np.ndarray], places: list[tuple], asks: np.ndarray | None = None,
                    told: np.ndarray | None = None) -> np.ndarray:
    """Which sets have a similar one at an earlier place; ``sets`` stand in order of ``places``.

    ``asks`` limits the sets that look for a match, ``told`` those they look at.
    An inverted index of the prefixes is grown in order.  A pair is dropped by
    size, or as soon as the shingles left after a common one cannot reach the
    overlap it needs; the rest is verified until the first match.
    """
    matched = np.zeros(len(sets), bool)
    index: dict[int, list[tuple[int, int]]] = {}
    whole: dict[int, set[int]] = {}

    def common_with(x: int, y: int) -> int:
        if x not in whole:
            whole.clear()  # one set is asked for at a time
            whole[x] = set(sets[x].tolist())
        return len(whole[x].intersection(sets[y].tolist()))

    for x, own in enumerate(sets):
        n = len(own)
        prefix = own[:n // 4 + 1].tolist()
        if asks is None or asks[x]:
            common: dict[int, int] = {}
            for i, shingle in enumerate(prefix):
                for y, j in index.get(shingle, ()):
                    m = len(sets[y])
                    if BELOW * min(n, m) < ABOVE * max(n, m):
                        continue
                    so_far = common.get(y, 0)
                    if so_far < 0:
                        continue
                    common[y] = so_far + 1 if so_far + 1 + min(n - i, m - j) - 1 >= least_common(n, m) else -1
            for y, count in common.items():
                if count > 0 and places[y] < places[x] and similar(common_with(x, y), n, len(sets[y])):
                    matched[x] = True
                    break
        if told is None or told[x]:
            for i, shingle in enumerate(prefix):
                index.setdefault(shingle, []).append((x, i))
    return matched


def _members(group: pa.RecordBatch) -> tuple[list[np.ndarray], list[tuple]]:
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("set")]
    return sets, list(zip(group.column("f_id").to_pylist(), group.column("f_line").to_pylist()))


def small_matches(values: np.ndarray, starts: np.ndarray, group: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``earlier_matches`` for many groups at once: which sets have a similar one at an earlier place of their group.

    Sets stand in order of group, then place.  The prefixes of all groups are
    sorted, so sets that share a shingle stand together; the size and the first
    common shingle decide which pairs are verified.
    """
    n = np.diff(starts)
    size = n // 4 + 1
    owner = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    prefix = values[starts[owner] + at]
    order = np.lexsort((prefix, group[owner]))
    owner, at, prefix = owner[order], at[order], prefix[order]
    run = np.concatenate([[0], np.cumsum((prefix[1:] != prefix[:-1]) | (group[owner[1:]] != group[owner[:-1]]))])
    found = []
    for step in range(1, len(run)):
        first = np.flatnonzero(run[step:] == run[:-step])
        if not len(first):
            break
        x, y = owner[first + step], owner[first]  # equal keys keep the order of the sets: y stands before x
        fits = (BELOW * np.minimum(n[x], n[y]) >= ABOVE * np.maximum(n[x], n[y])) & (places[x] != places[y]).any(axis=1)
        found.append(np.stack([x, y, at[first + step], at[first]])[:, fits])
    matched = np.zeros(len(n), bool)
    if not found:
        return matched
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((pairs[2], pairs[1], pairs[0]))]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)
    x, y, i, j = pairs[:, new]  # each pair with its first common shingle, which has all others behind it in both sets
    near = np.minimum(n[x] - i, n[y] - j) >= -(-ABOVE * (n[x] + n[y]) // (ABOVE + BELOW))
    last, whole = -1, set()
    for a, b in zip(x[near].tolist(), y[near].tolist()):
        if matched[a]:
            continue
        if a != last:
            last, whole = a, set(values[starts[a]:starts[a + 1]].tolist())
        matched[a] = similar(len(whole.intersection(values[starts[b]:starts[b + 1]].tolist())), n[a], n[b])
    return matched


def group_matches(rows: pa.RecordBatch, groups: np.ndarray) -> np.ndarray:
    """Which of the ``rows`` match an earlier one of their group; small groups are taken together."""
    values, starts = lists(rows.column("set"))
    places = np.stack([rows.column("f_id").to_numpy(), rows.column("f_line").to_numpy()], axis=1)
    matched = np.zeros(len(rows), bool)
    members = np.diff(groups)
    prefix = np.concatenate([[0], np.cumsum(np.diff(starts) // 4 + 1)])
    cost = members * (prefix[groups[1:]] - prefix[groups[:-1]])
    small = (members <= SMALL) & (cost <= LOT)
    lot = np.cumsum(np.where(small, cost, 0)) // LOT
    ends = np.flatnonzero(np.concatenate([(lot[1:] != lot[:-1]) | ~small[1:] | ~small[:-1], [True]])) + 1
    for a, b in zip([0, *ends.tolist()], ends.tolist()):
        of, to = int(groups[a]), int(groups[b])
        if small[a]:
            matched[of:to] = small_matches(values[starts[of]:starts[to]], starts[of:to + 1] - starts[of],
                                           np.repeat(np.arange(b - a), members[a:b]), places[of:to])
        else:
            matched[of:to] = earlier_matches([values[starts[i]:starts[i + 1]] for i in range(of, to)], [tuple(p) for p in places[of:to].tolist()])
    return matched


def later_lines(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``d1, d2`` of the lines that match an earlier one.

    ``pairs`` are the dealt families, ``held`` has ``d1, d2, f_id, f_line, set``.  Families
    above one block are worked through block by block; members that found no
    match there are then compared with the other blocks.
    """
    parts = partitions(pairs.sparkSession)
    several = pairs.filter("_nb > 1").limit(1).count() > 0
    placed = cut(pairs.join(held, "d1"), "line-families") if several else pairs.join(held, "d1")
    first = placed.withColumn("_b", F.explode(F.when(
        F.col("d1") == F.col("l_d1"), F.sequence(F.lit(0), F.col("_nb") - 1)).otherwise(F.array("_b")))) if several else placed

    def inside(batches):
        for rows, groups in whole_groups(batches, ["l_d1", "_b"]):
            matched = group_matches(rows, groups)
            open_ = ~matched & (rows.column("_nb").to_numpy() > 1) & (rows.column("d1").to_numpy() != rows.column("l_d1").to_numpy())
            told = pa.array(matched | open_)
            yield pa.RecordBatch.from_arrays(
                [rows.column(c).filter(told) for c in ("l_d1", "d1", "d2")] + [pa.array(matched[matched | open_])],
                ["l_d1", "d1", "d2", "matched"])

    found = cut(first.repartition(parts, "l_d1", "_b").sortWithinPartitions("l_d1", "_b", "f_id", "f_line").mapInArrow(
        inside, "l_d1 bigint, d1 bigint, d2 bigint, matched boolean"), "line-matches")
    matches = found.filter("matched").select("d1", "d2")
    if not several:
        return matches.distinct()
    asking = placed.join(found.filter("not matched").select("l_d1", "d1", "d2").distinct(), ["l_d1", "d1", "d2"]) \
        .withColumn("_i", F.col("_b")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))) \
        .filter("_i != _j").withColumn("_asks", F.lit(True))
    told = placed.filter("_nb > 1").withColumn("_j", F.col("_b")).join(asking.select("l_d1", "_i").distinct(), "l_d1") \
        .filter("_i != _j").withColumn("_asks", F.lit(False))
    columns = ["l_d1", "_i", "_j", "d1", "d2", "f_id", "f_line", "set", "_asks"]

    def across(batches):
        for group in each_group(batches, ["l_d1", "_i", "_j"]):
            asks = group.column("_asks").to_numpy(zero_copy_only=False)
            matched = pa.array(earlier_matches(*_members(group), asks, ~asks))
            yield pa.RecordBatch.from_arrays([group.column(c).filter(matched) for c in ("d1", "d2")], ["d1", "d2"])

    second = asking.select(columns).unionByName(told.select(columns)).repartition(parts, "l_d1", "_i", "_j") \
        .sortWithinPartitions("l_d1", "_i", "_j", "f_id", "f_line").mapInArrow(across, "d1 bigint, d2 bigint")
    return matches.unionByName(second).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "_lines",
                removed_col: str = "_removed") -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, and with the numbers of lines before and of lines removed.

    ``lines_col`` and ``removed_col`` name these two, with underscores added
    where ``docs`` has a column of that name, which stays as it is.

    Lines are parted by ``\\n`` and ordered by identifier, then place.  A line
    goes if any earlier line, removed or not, has a Jaccard similarity of
    three quarters or more; lines without words stay.
    Null texts stay null, empty ones empty.  Rows without identifier come
    last.  Lines at the same place of rows that share an identifier are not
    later than each other.  Shingles are compared by 64-bit hashes.
    """
    lines_col, removed_col = unused(lines_col, docs.columns), unused(removed_col, docs.columns)
    gone_col = unused("_gone", [*docs.columns, lines_col, removed_col])
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("_id"), F.xxhash64(text_col).alias("_h"),
                       F.col(text_col).alias("_t"))
    classes = rarity(rows, line_sets)
    lines = cut(line_table(rows, classes), "lines")
    firsts = cut(lines.groupBy("d1", "d2").agg(
        F.min(F.struct("_id", "line", "_h")).alias("_f"), F.count("*").alias("_n")).select(
        "d1", "d2", F.col("_f._id").alias("f_id"), F.col("_f.line").alias("f_line"), F.col("_f._h").alias("f_h"), "_n"), "first-lines")

    # The first part of the digest names a line here: a chance clash only makes a family larger.
    posts = packed_postings(lines.filter(F.octet_length("keys") > 0).select("d1", "keys"), "d1")
    pairs = cut(dealt(with_leaders(packed_families(posts, "d1"), ["d1"]), ["d1"]), "line-pairs")
    wanted = cut(firsts.join(pairs.select("d1").distinct(), "d1", "left_semi").drop("_n"), "family-lines")
    few = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    # One entry per line of a text at most.
    by_text = wanted.groupBy(F.col("f_id").alias("_id"), F.col("f_h").alias("_h")).agg(F.collect_set("f_line").alias("_wanted"))
    sets = packed_lines(rows.join(F.broadcast(by_text) if few else by_text, ["_id", "_h"]), classes)
    held = sets.join(F.broadcast(wanted) if few else wanted, (F.col("f_id") == sets["_id"]) & (F.col("f_line") == sets["line"]) & (
        F.col("f_h") == sets["_h"])).select("d1", "d2", "f_id", "f_line", "set")
    later = later_lines(pairs, held)

    # Only classes with a copy or an earlier match have lines to remove.
    telling = firsts.join(later.withColumn("_late", F.lit(True)), ["d1", "d2"], "left").filter("_n > 1 or _late") \
        .select("d1", "d2", "f_id", "f_line", F.coalesce("_late", F.lit(False)).alias("_late"))
    # A line that very many texts share is split by the planner's handling of skewed joins.
    gone = lines.join(telling, ["d1", "d2"]).filter(
        F.col("_late") | (F.col("_id") != F.col("f_id")) | (F.col("line") != F.col("f_line")))
    # One entry per line of a text at most.
    per_text = cut(gone.groupBy("_id", "_h").agg(F.collect_set("line").alias("_gone")), "removed-lines")
    size = per_text.agg(F.count("*").alias("rows"), F.sum(F.size("_gone") * 8 + 64).alias("bytes")).first()
    few = size["rows"] <= BROADCAST_LINES and (size["bytes"] or 0) <= BROADCAST_BYTES
    joined = docs.join(
        F.broadcast(per_text) if few else per_text,
        (F.coalesce(docs[id_col].cast("bigint"), F.lit(LAST)) == per_text["_id"]) & (F.xxhash64(docs[text_col]) == per_text["_h"]),
        "left").select(*[docs[c] for c in docs.columns], per_text["_gone"].alias(gone_col))
    names = docs.columns
    at = names.index(text_col)

    def rebuild(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, out in zip(batch.column(text_col).to_pylist(), batch.column(gone_col).to_pylist()):
                parts, drop = text.split("\n"), set(out)
                texts.append("\n".join([p for i, p in enumerate(parts) if i not in drop]))
                counts.append(len(parts))
                removed.append(len(drop))
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*names, lines_col, removed_col])

    # Texts that lose nothing stay in the JVM; only where texts were shuffled would telling them apart read them twice.
    whole = joined.filter(F.col(gone_col).isNull()).drop(gone_col)
    same = whole.withColumn(lines_col, F.coalesce(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")) \
        .withColumn(removed_col, F.lit(0).cast("long"))
    return same.unionByName(joined.filter(F.col(gone_col).isNotNull()).mapInArrow(rebuild, same.schema))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without repeated lines, as digests of the texts that are left."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
