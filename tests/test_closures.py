"""Category closures: against a plain walk, and their number of rounds."""

import random

from stockloom.operators import network as nw


def walked(edges, roots):
    known, todo = set(roots), list(roots)
    while todo:
        p = todo.pop()
        for c, q in edges:
            if q == p and c not in known:
                known.add(c)
                todo.append(c)
    return known


def test_closures_of_any_graph(spark):
    rng = random.Random(3)
    for size in (1, 12, 60):
        edges = [(rng.randrange(size), rng.choice([None, *range(size)])) for _ in range(size + size // 3)]
        roots = rng.sample(range(size), max(1, size // 15)) + [size + 5]
        df = nw.expand_categories(spark.createDataFrame(edges, "category_id long, parent_id long"), spark.createDataFrame([(r,) for r in roots], "category_id long"))
        got = [r.category_id for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == walked(edges, roots)


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    calls = []
    real = nw.checkpointed
    monkeypatch.setattr(nw, "checkpointed", lambda df: calls.append(1) or real(df))
    edges = spark.createDataFrame([(i + 1, i) for i in range(1000)], "category_id long, parent_id long")
    assert nw.expand_categories(edges, spark.createDataFrame([(0,)], "category_id long")).count() == 1001
    assert (len(calls) - 2) / 2 <= 12
