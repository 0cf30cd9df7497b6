"""Memory of kernels that run beside each other in an executor."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quirework.llm import decontamination
from quirework.llm.numtext import chunks, folded


def test_search_for_items_takes_little_memory():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), n)) for n in rng.integers(2, 9, 3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [text(40) for _ in range(200)]
    docs = [text(300) for _ in range(1400)]
    docs[7] += " " + items[3]
    tracemalloc.start()
    held = decontamination.Items(list(range(200)), items)
    found = []
    for lo, _, data, at in chunks(pa.array(docs, pa.string()), decontamination.SEARCHED_BYTES):
        found += [(lo + r, i) for r, i, _ in held.hits(*folded(data, at), 0.8)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(7, 3)] and peak < 90e6
