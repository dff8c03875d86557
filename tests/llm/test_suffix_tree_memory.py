"""What a worker holds while it scores texts, and what is shuffled to make the tree."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from cloakframe.llm import suffix_tree


def test_blocks_are_let_go_one_by_one(monkeypatch):
    """Scoring several blocks takes little more memory than scoring one; the arrays of the block before were held too."""
    size = 1 << 18
    monkeypatch.setattr(suffix_tree, "GRAMS", size)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(size - 16))
    model = suffix_tree.Tree.of(np.zeros(0, np.uint64), np.zeros(0))
    peaks = []
    for n in (1, 4):
        texts = pa.array([text] * n)
        tracemalloc.start()
        scores = model.word_scores(texts)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(scores) == n and len(set(scores.tolist())) == 1
    assert peaks[1] < 1.1 * peaks[0], peaks


def test_counts_are_shuffled_many_to_a_row(spark, monkeypatch):
    """Counts were shuffled and sorted one a row, the step that took most of an executor's heap; blocks, long texts and nulls are counted alike."""
    rng = random.Random(6)
    texts = [None, "", *("".join(rng.choice("abcdefgh") for _ in range(20_000)) for _ in range(10))]
    codes, n = np.unique(suffix_tree.grams(*suffix_tree.symbols(pa.array(texts))), return_counts=True)
    made = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for block, gathered in ((1 << 20, 1 << 20), (30_000, 50_000), (30_000, 1_000)):
        monkeypatch.setattr(suffix_tree, "GRAMS", block)
        monkeypatch.setattr(suffix_tree, "GATHERED", gathered)
        rows = suffix_tree.gram_counts(made).toArrow()
        assert rows.num_rows * 4 < len(codes)
        got = [suffix_tree._summed(*x) for x in suffix_tree.whole_lots(rows.sort_by("lot").to_batches(max_chunksize=100))]
        tops = [set((c >> np.uint64(40)).tolist()) for c, _ in got]
        assert len(got) > 1 or len(codes) <= suffix_tree.CHUNK
        assert sum(map(len, tops)) == len(set().union(*tops))  # contexts that share three bytes come together
        own, often = suffix_tree._summed(*map(np.concatenate, zip(*got)))
        assert (own == codes).all() and (often == n).all()


def test_a_large_lot_is_summed_as_it_is_read(monkeypatch):
    """Rows of one lot from many tasks take the memory of its distinct codes; all were held before."""
    monkeypatch.setattr(suffix_tree, "CHUNK", 1 << 13)
    rng = np.random.default_rng(8)
    codes = np.sort(rng.choice(1 << 30, 5_000, replace=False)).astype(np.uint64) | np.uint64(7 << 40)
    few = np.array([1 << 60, 1 << 61], np.uint64)
    own, = suffix_tree.packed_counts(codes, np.arange(1, 5_001), 1)
    other = pa.RecordBatch.from_arrays(
        [pa.array([1], pa.int32()), suffix_tree.packed(np.stack([few, np.array([4, 5], np.uint64)], axis=1), np.array([0, 4]))], own.schema.names)
    peaks = []
    for times in (10, 200):
        tracemalloc.start()
        got = list(suffix_tree.whole_lots(b for b in [*[own] * times, other]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        summed = suffix_tree._summed(*map(np.concatenate, zip(*got)))
        assert summed[0].tolist() == [*codes.tolist(), *few.tolist()]
        assert summed[1].tolist() == [*(times * np.arange(1, 5_001)).tolist(), 4, 5]
    assert peaks[1] < 1.2 * peaks[0], peaks
