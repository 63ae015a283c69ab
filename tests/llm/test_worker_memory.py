"""What a worker holds once a task is done."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from placebook.llm import arrays
from placebook.llm.common import within_arrow


def held_mb() -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024


def test_nothing_large_stays_after_a_task():
    draw = np.random.default_rng(5)
    texts = ["".join(map(chr, draw.integers(97, 123, 2000))) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        arrays.words_of(part.column("text"))
        return part

    before = held_mb()
    for _ in within_arrow([batch], make, "text", 1_500_000):
        assert len(arrays._POWERS["up"]) > 1_000_000
    assert len(arrays._POWERS["up"]) == 1
    assert held_mb() - before < 20
