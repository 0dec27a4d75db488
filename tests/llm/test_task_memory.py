"""What a task holds beside its texts is bounded by a piece of them, not by the Arrow batch or the block."""

from __future__ import annotations

import random
import tracemalloc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import common
from tallyloom.llm.op8_toxicity import trigram_counts
from tallyloom.llm.op10_near_dedup import Likeness, Postings, signatures


class Docs:
    """Stands for a table; keeps the function that its tasks would run."""

    def __getattr__(self, name: str) -> Callable:
        return lambda *_: self

    def mapInArrow(self, run: Callable, schema: str) -> Docs:  # noqa: N802
        self.run = run
        return self


def peak(work: Callable) -> float:
    """MB at most, beyond what was held before."""
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


@pytest.mark.usefixtures("spark")
@pytest.mark.parametrize("job", [trigram_counts, lambda docs: signatures(docs, Likeness())])
def test_a_batch_of_texts_is_worked_on_in_pieces(job: Callable, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(common, "_powers", None)
    rng = random.Random(4)
    text = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text)), pa.int64()), pa.array(text)], names=["doc_id", "text"])
    docs = Docs()
    job(docs)
    assert batch.nbytes > 5e6
    assert peak(lambda: list(docs.run(iter([batch])))) < 45


def test_postings_of_equal_sets_are_counted_in_steps() -> None:
    rng = np.random.default_rng(1)
    own = np.unique(rng.integers(0, 1 << 60, 300))
    some = [own, own[::2], own[:7], own[:0], rng.integers(1 << 61, 1 << 62, 50)]
    sets = [some[i % len(some)] for i in range(4000)]
    posts = Postings(sets)
    assert posts.overlaps(own).tolist() == [int(np.isin(s, own).sum()) for s in sets]
    assert peak(lambda: posts.overlaps(own)) < 4
