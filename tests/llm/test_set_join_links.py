"""Links at the threshold: whether two texts meet does not depend on how often one is repeated."""

import random

import numpy as np
import pytest

from stockloom.llm import set_join
from tests.llm.conftest import sentence
from tests.llm.test_queries import jaccard_roots


def pair_at(rng: random.Random, words: int, share: float) -> tuple[str, str]:
    """A text, and the same with so many more words that their Jaccard similarity is about ``share``."""
    base = sentence(rng, words).split()
    more = sentence(rng, int((words - 4) / share) - (words - 4)).split()
    return " ".join(base), " ".join(base + more)


@pytest.mark.parametrize("copies", [1, 16, 50])
def test_linked_sets_meet_however_often_one_occurs(copies):
    rng = np.random.default_rng(copies)
    for i in range(4000):
        n = int(rng.integers(100, 1200))
        b = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        more = rng.integers(0, 2**64, int(len(b) / rng.uniform(0.75, 0.8)) - len(b), dtype=np.uint64)
        a = np.unique(np.concatenate([b, more]))
        frequent = rng.permutation(b)[: int(len(b) * rng.uniform(0, 1))] if copies > 1 else b[:0]
        frequent.sort()
        assert len(np.intersect1d(set_join.ordered_prefix(a, frequent), set_join.ordered_prefix(b, frequent))), i


def test_whole_prefix_on_request():
    values = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert len(set_join.ordered_prefix(values, values[:20], None)) == len(values) // 4 + 1
    assert set_join.prefix_size(0, 0, None) == 0
    assert set(set_join.ordered_prefix(values, values[:20])) <= set(set_join.ordered_prefix(values, values[:20], None))


@pytest.mark.parametrize("miss", [set_join.MISS, None])
def test_groups_of_copies_at_the_threshold(spark, miss):
    rng = random.Random(11)
    texts, at = {}, 0
    for copies in (1, 16, 20, 50):
        for share in (0.75, 0.76, 0.8, 0.74):
            small, large = pair_at(rng, rng.choice([60, 300, 679]), share)
            for text in [*[small] * copies, large]:
                texts[at := at + 1] = text
    got = set_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6), miss=miss).collect()
    assert {r.doc_id: r.component_id for r in got} == jaccard_roots(texts)
