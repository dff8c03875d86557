"""What a worker holds while and after it encodes texts."""

import random
import re
import tracemalloc

import pyarrow as pa

from cloakframe.llm import bpe
from cloakframe.llm.common import blocks


def _resident() -> int:
    with open("/proc/self/smaps_rollup") as lines:
        return int(re.search(r"\nAnonymous:\s+(\d+)", lines.read())[1]) << 10


def _made() -> tuple[list[str], bpe.Encoder]:
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(5_000)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(8_000)]
    return texts, bpe.Encoder(bpe.PerfectHash({bytes((b,)): b for b in range(256)}), bpe.public_vocabulary()[1])


def test_working_arrays_stay_small():
    """Encoding a batch takes a few times its block in arrays and lists, not several times the batch."""
    texts, encoder = _made()
    size = sum(map(len, texts))
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    done = sum(len(encoder.block(part.column("text"))) for part in blocks(batch, "text", bpe.ENCODED))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == len(texts) and peak < 5 * size, (peak, size)


def test_blocks_give_memory_back():
    """After the last block of a batch Arrow keeps little of the memory that the blocks took; nulls and empty texts are blocks too."""
    texts, encoder = _made()
    batch = pa.RecordBatch.from_pydict({"text": [None, "", *texts]})
    done = 0
    for part in blocks(batch, "text", 4 << 20):
        done += len(encoder.block(part.column("text").fill_null("")))
        del part
    kept = _resident()
    pa.default_memory_pool().release_unused()
    kept -= _resident()
    assert done == len(texts) + 2 and kept < 5 << 20, kept
