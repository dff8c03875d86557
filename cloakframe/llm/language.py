"""Language identification by unigrams summed over all segmentations.

Each language has one probability per piece of a fixed public vocabulary.  The
probability of a word is the sum over all ways to cut it into pieces, worked
out by the forward algorithm; piece probabilities are fitted by
expectation-maximisation with the forward-backward counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import public_vocabulary, read_ranks
from .common import blocks, cut, raw_bytes, table

# Words up to this many bytes are scored many at a time, a longer one by itself.
LONG = 512
# Sums are scaled after so many bytes, so that long words do not run out of the number range.
STEP = 8
# A long word's pieces are looked up for so many starts at a time.
STARTS = 1 << 16
# About so many labelled documents per language are fitted on, chosen by a hash of the identifier.
SAMPLE = 3_000
ROUNDS = 3
SMOOTH = 0.01
# Texts are taken in blocks of this size; words in groups of at most this many, whose sums hold about so many numbers.
TEXTS = 8 << 20
GROUP = 1 << 14
CELLS = 1 << 21
_LETTERS = r"[^\p{L}]+"


class Pieces:
    """The vocabulary as a tree of bytes: node 0 is the root, the others are numbered by their sorted keys.

    A node's key is its parent's number and its own byte; ``piece`` is the
    number of the piece that ends in a node, or -1.
    """

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.size = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=0)
        number, keys, piece = {b"": 0}, [], [-1]
        ids = {p: i for i, p in enumerate(vocabulary)}
        for n in range(1, self.longest + 1):
            for prefix in sorted({p[:n] for p in vocabulary if len(p) >= n}):
                number[prefix] = len(piece)
                keys.append(number[prefix[:-1]] << 8 | prefix[-1])
                piece.append(ids.get(prefix, -1))
        self.keys, self.piece = np.array(keys, np.int64), np.array(piece, np.int64)

    def _step(self, nodes: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes go on with the given bytes, and the nodes these lead to."""
        wanted = nodes << 8 | following
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        goes = self.keys[at] == wanted
        return goes, at[goes] + 1

    def starting(self, matrix: np.ndarray, sizes: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(end, rows, pieces)`` of every piece that starts there in the words, whose sizes ascend."""
        rows = np.arange(np.searchsorted(sizes, start, side="right"), len(sizes))
        nodes = np.zeros(len(rows), np.int64)
        for end in range(start + 1, matrix.shape[1] + 1):
            if len(rows) and sizes[rows[0]] < end:
                going = sizes[rows] >= end
                rows, nodes = rows[going], nodes[going]
            if not len(rows):
                return
            goes, nodes = self._step(nodes, matrix[rows, end - 1])
            rows = rows[goes]
            ids = self.piece[nodes]
            ending = ids >= 0
            if ending.any():
                yield end, rows[ending], ids[ending]

    def edges(self, data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends and numbers of the pieces of one word that start in a range, by start, and where each start's begin."""
        starts, nodes, found = np.arange(low, high), np.zeros(high - low, np.int64), []
        for n in range(1, self.longest + 1):
            going = starts + n <= len(data)
            starts, nodes = starts[going], nodes[going]
            if not len(starts):
                break
            goes, nodes = self._step(nodes, data[starts + n - 1])
            starts = starts[goes]
            ids = self.piece[nodes]
            ending = ids >= 0
            found.append((starts[ending], np.full(ending.sum(), n), ids[ending]))
        start, n, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(start, kind="stable")
        start, n, ids = start[order], n[order], ids[order]
        return start + n, ids, np.searchsorted(start, np.arange(low, high + 1))


def pieces_of(path: str) -> list[bytes]:
    """Pieces of the public vocabulary: all single bytes and every entry."""
    return sorted({bytes([b]) for b in range(256)} | set(read_ranks(path)))


def _groups(words: pa.Array, most: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(word numbers, bytes matrix, sizes)`` of words with a space in front, sizes in order.

    Up to ``most`` words of up to ``LONG`` bytes come together, ``cells`` bytes
    at most; a longer one comes alone.
    """
    data, ends = raw_bytes(words)
    data, sizes = np.append(data, np.zeros(LONG, np.uint8)), np.diff(ends)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        many = max(1, min(most, cells // (min(int(sizes[order[min(at + most, len(order)) - 1]]), LONG) + 1)))
        own = order[at:at + many]
        if sizes[own[-1]] > LONG:
            own = own[:max(1, np.searchsorted(sizes[own], LONG, side="right"))]
        widest = int(sizes[own[-1]])
        matrix = np.full((len(own), widest + 1), 32, np.uint8)
        matrix[:, 1:] = data[ends[own][:, None] + np.arange(widest)]
        yield own, matrix, sizes[own] + 1
        at += len(own)


def _positive(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, 1.0)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def _long_score(pieces: Pieces, chance: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Natural log probability of one word in every language, range by range of starts."""
    sums = np.zeros((pieces.longest + 1, chance.shape[1]))
    sums[0], told = 1.0, np.zeros(chance.shape[1])
    for low in range(0, len(data), STARTS):
        high = min(low + STARTS, len(data))
        ends, ids, begins = pieces.edges(data, low, high)
        ends, sums = ends - low, np.concatenate([sums, np.zeros((high - low, chance.shape[1]))])
        for start in range(high - low):
            here = sums[start]
            if start % STEP == 0:
                top = _positive(here)
                told += np.log(top)
                sums[start:start + pieces.longest + 1] /= top
            own = slice(begins[start], begins[start + 1])
            sums[ends[own]] += here * chance[ids[own]]
        sums = sums[high - low:]
    return _log(sums[0]) + told


def word_scores(pieces: Pieces, chance: np.ndarray, words: pa.Array) -> np.ndarray:
    """Natural log probability of every word in every language; ``chance`` is pieces by languages."""
    languages = chance.shape[1]
    scores = np.zeros((len(words), languages))
    ahead = pieces.longest + STEP
    most = max(1, min(GROUP, CELLS // (ahead * max(1, languages))))
    for owner, matrix, sizes in _groups(words, most, CELLS // 2):
        if sizes[0] > LONG + 1:
            scores[owner[0]] = _long_score(pieces, chance, matrix[0])
            continue
        sums = np.zeros((ahead, len(owner), languages))
        sums[0], told, base = 1.0, np.zeros((len(owner), languages)), 0
        for start in range(matrix.shape[1] + 1):
            if start - base == STEP:
                sums[:-STEP] = sums[STEP:]
                sums[-STEP:] = 0.0
                base, top = start, _positive(sums[0])
                told += np.log(top)
                sums[:-STEP] /= top
            here = sums[start - base]
            done = slice(*np.searchsorted(sizes, [start, start + 1]))
            scores[owner[done]] = _log(here[done]) + told[done]
            for end, rows, ids in pieces.starting(matrix, sizes, start):
                sums[end - base, rows] += here[rows] * chance[ids]
    return scores


def _long_counts(pieces: Pieces, chance: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Piece numbers and expected counts of one word, range by range of starts; ``chance`` is of its language."""
    size, reach = len(data), pieces.longest + 1
    forward, told = np.zeros(size + reach), np.zeros(size // STEP + 1)
    forward[0] = 1.0
    for low in range(0, size, STARTS):
        ends, ids, begins = pieces.edges(data, low, min(low + STARTS, size))
        likely = chance[ids]
        for start in range(low, min(low + STARTS, size)):
            if start % STEP == 0 and start:
                top = forward[start] or 1.0
                told[start // STEP] = told[start // STEP - 1] + np.log(top)
                forward[start:start + reach] /= top
            own = slice(begins[start - low], begins[start - low + 1])
            forward[ends[own]] += forward[start] * likely[own]
    # The end is reached from the block of the last start; its own sums were not scaled since.
    whole = _log(forward[size]) + told[(size - 1) // STEP]
    backward, back = np.zeros(size + reach), 0.0
    backward[size] = 1.0
    for low in range((size - 1) // STARTS * STARTS, -1, -STARTS):
        ends, ids, begins = pieces.edges(data, low, min(low + STARTS, size))
        likely, share = chance[ids], np.zeros(len(ids))
        for start in range(min(low + STARTS, size) - 1, low - 1, -1):
            if start % STEP == STEP - 1:
                top = backward[start + 1] or 1.0
                back += np.log(top)
                backward[start + 1:start + 1 + reach] /= top
            own = slice(begins[start - low], begins[start - low + 1])
            way = likely[own] * backward[ends[own]]
            backward[start] = way.sum()
            share[own] = way * (forward[start] * np.exp(told[start // STEP] + back - whole))
        yield ids, share


def expected_counts(pieces: Pieces, chance: np.ndarray, words: pa.Array, language: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Forward-backward counts of the pieces, by language, in words seen ``times`` often."""
    counts = np.zeros(chance.shape)
    for owner, matrix, sizes in _groups(words, GROUP, CELLS // 8):
        lang, seen, width = language[owner], times[owner], matrix.shape[1]
        if sizes[0] > LONG + 1:
            for ids, share in _long_counts(pieces, chance[:, lang[0]], matrix[0]):
                counts[:, lang[0]] += np.bincount(ids, share * seen[0], len(counts))
            continue
        forward, told = np.zeros((width + 1, len(owner))), np.zeros((width // STEP + 1, len(owner)))
        forward[0] = 1.0
        whole = np.zeros(len(owner))
        for start in range(width + 1):
            block = start // STEP
            if start % STEP == 0 and start:
                top = _positive(forward[start])
                told[block] = told[block - 1] + np.log(top)
                forward[start:start + pieces.longest] /= top
            done = slice(*np.searchsorted(sizes, [start, start + 1]))
            whole[done] = _log(forward[start, done]) + told[block, done]
            for end, rows, ids in pieces.starting(matrix, sizes, start):
                forward[end, rows] += forward[start, rows] * chance[ids, lang[rows]]
        backward, back = np.zeros((width + 1, len(owner))), np.zeros(len(owner))
        backward[sizes, np.arange(len(owner))] = 1.0
        for start in range(width - 1, -1, -1):
            if start % STEP == STEP - 1:
                top = _positive(backward[start + 1])
                back += np.log(top)
                backward[start + 1:start + 1 + pieces.longest] /= top
            here = forward[start] * np.exp(told[start // STEP] + back - whole) * seen
            for end, rows, ids in pieces.starting(matrix, sizes, start):
                way = chance[ids, lang[rows]] * backward[end, rows]
                backward[start, rows] += way
                np.add.at(counts, (ids, lang[rows]), way * here[rows])
    return counts


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Letter runs in lower case: where each text's runs start, and the runs as codes of distinct ones."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())), _LETTERS)
    starts = lists.offsets.to_numpy()
    return starts - starts[0], lists.flatten().dictionary_encode()


def fit(labelled: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Languages (in code point order) and piece probabilities, from ``_id, _t, _lang`` rows without nulls in ``_lang``.

    At most about ``SAMPLE`` documents per language are used.  The driver holds
    one number per piece and language; words and counts stay with Spark.
    """
    spark = labelled.sparkSession
    sizes = {r["_lang"]: r["n"] for r in labelled.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    pieces = Pieces(pieces_of(path))
    chance = np.full((pieces.size, len(languages)), 1.0 / pieces.size)
    if not languages:
        return [], chance
    limits = F.create_map(*[x for s in languages for x in (F.lit(s), F.lit(min(1.0, SAMPLE / sizes[s])))])
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 20)) < limits[F.col("_lang")] * (1 << 20))
    number = F.create_map(*[x for i, s in enumerate(languages) for x in (F.lit(s), F.lit(i))])

    def count(batches):
        for batch in batches:
            for part in blocks(batch, "_t", TEXTS):
                starts, runs = _split(part.column("_t"))
                lang = np.repeat(part.column("_l").to_numpy(), np.diff(starts))
                keys, n = np.unique(runs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(languages) + lang, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys % len(languages), pa.int32()), runs.dictionary.take(pa.array(keys // len(languages))).cast(pa.string()),
                     pa.array(n, pa.int64())], ["_l", "word", "n"])

    words = cut(sample.select("_t", number[F.col("_lang")].alias("_l")).mapInArrow(count, "_l int, word string, n bigint")
                .filter("word != ''").groupBy("_l", "word").agg(F.sum("n").alias("n")), "language-words")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((pieces, chance))

        def expect(batches):
            known, now = shared.value
            total = np.zeros(now.shape)
            for batch in batches:
                total += expected_counts(known, now, batch.column("word"), batch.column("_l").to_numpy(), batch.column("n").to_numpy())
            at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at], pa.float64())], ["p", "l", "c"])

        rows = words.mapInArrow(expect, "p int, l int, c double").groupBy("p", "l").agg(F.sum("c").alias("c")).toArrow()
        counts = np.full(chance.shape, SMOOTH)
        counts[rows["p"].to_numpy(), rows["l"].to_numpy()] += rows["c"].to_numpy()
        chance = counts / counts.sum(axis=0)
    return languages, chance


def predict(docs: DataFrame, languages: list[str], chance: np.ndarray, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of the best language in the likelihoods.

    ``und`` with score 0 stands for a null text, one without letters, or no
    language to choose from.  Ties go to the first language in code point
    order.  Nothing is shuffled; existing columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Pieces(pieces_of(path)), chance))
    rest = docs.drop("lang_pred", "score")

    def run(batches):
        pieces, likely = shared.value
        for batch in batches:
            for part in blocks(batch, text_col, TEXTS):
                best, score = np.zeros(len(part), np.int64), np.zeros(len(part))
                starts, runs = _split(part.column(text_col))
                heard = np.zeros(len(part), bool)
                if len(languages) and len(runs):
                    codes = runs.indices.to_numpy(zero_copy_only=False)
                    empty = pc.equal(runs.dictionary, "").to_numpy(zero_copy_only=False)
                    own = word_scores(pieces, likely, runs.dictionary)
                    own[empty] = 0.0
                    sums = np.concatenate([np.zeros((1, len(languages))), np.cumsum(own[codes], axis=0)])
                    total = sums[starts[1:]] - sums[starts[:-1]]
                    letters = np.concatenate([[0], np.cumsum(~empty[codes])])
                    heard = letters[starts[1:]] > letters[starts[:-1]]
                    best = total.argmax(axis=1)
                    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names = [languages[b] if ok else "und" for b, ok in zip(best, heard)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(np.where(heard, score, 0.0))],
                    [*part.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, rest.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents; one in five is held out of the fit by its identifier's checksum."""
    path, _ = public_vocabulary()
    docs = table(spark, folder, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    labelled = docs.filter((rest != 0) & F.col("lang").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col("text").alias("_t"), F.col("lang").alias("_lang"))
    languages, chance = fit(labelled, path)
    rows = docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text")
    return predict(rows, languages, chance, path).drop("text")
