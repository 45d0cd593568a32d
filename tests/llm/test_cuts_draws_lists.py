"""Fill-in-middle, importance resampling and top-k search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockloom.llm import importance_quickselect as draws
from stockloom.llm import middle_cuts as cuts
from stockloom.llm import threshold_topk as topk
from stockloom.llm.queries import QUERIES
from tests.llm.conftest import sentence

PIECES = ["a", "bc", "\n", "\r\n", "é", "日本", "🙂", "<", "<P", "S>", "<M>", "<S>", "<P>", ">", " ", "\x00"]


# --- fill in middle ---------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6))
def test_offsets_both_ways(texts):
    whole = "".join(texts)
    index = cuts.MultibyteIndex(np.frombuffer(whole.encode(), np.uint8))
    at = np.arange(len(whole) + 1)
    want = np.array([len(whole[:i].encode()) for i in at])
    assert index.bytes(at).tolist() == want.tolist()
    assert index.chars(want).tolist() == at.tolist()


def filled(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i:i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in cuts.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,rate", [("line", 100), ("char", 100), ("char", 40)])
def test_fill_in_middle_against_strings(spark, unit, rate):
    rng = random.Random(unit)
    texts = [None, "", "\n", "x", "\n\n", "é" * 50_000, "a\n" * 40_000, "<", "x<S"] + ["".join(rng.choices(PIECES, k=rng.randint(1, 30))) for _ in range(400)]
    ids = [None, -5, 2**63 - 1, -(2**63), 7, 7] + list(range(100, 100 + len(texts) - 6))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("form", F.lit("x")).repartition(5)
    made = cuts.restored(cuts.fill_in_middle(docs, unit=unit, rate=rate)).collect()
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=str)
    assert got == sorted(((i, t or "", *filled(i, t, unit, rate)) for i, t in zip(ids, texts)), key=str)
    assert all(r.restored == r.text for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_sentinels_that_texts_could_imitate(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    for bad in (("aa", "b", "c"), ("", "b", "c"), ("<P>", "P>", "<M>"), ("<P>", "<PX", "><")):
        with pytest.raises(ValueError):
            cuts.fill_in_middle(docs, sentinels=bad)
    own = ("[[pre]]", "[[suf]]", "[[mid]]")
    assert cuts.restored(cuts.fill_in_middle(docs, sentinels=own), own).first().restored == "ab"


def test_restoring_keeps_nulls(spark):
    df = spark.createDataFrame([(None, "psm"), ("x", None)], "output string, form string")
    assert [r.restored for r in cuts.restored(df).collect()] == [None, "x"]


# --- importance resampling ----------------------------------------------------------------


def test_words_of_any_piece_size(monkeypatch):
    text = "Ünï-cöde ABC, 12x  _ " + "z" * 500 + " end"
    want = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABC", "abc")).replace("Ü", "Ü"))]
    for piece in (1, 3, 7, 100, 10_000):
        monkeypatch.setattr(draws, "PIECE", piece)
        assert [w for words in draws.word_lists(text.encode()) for w in words] == want
        for longest in (1, 2, 4):
            found = Counter(b for part in draws.feature_buckets(text.encode(), longest, draws.Buckets(10_000)) for b in part.tolist())
            runs = [b" ".join(want[i:i + n]) for n in range(1, longest + 1) for i in range(len(want) - n + 1)]
            assert found == Counter(zlib.crc32(r) % 10_000 for r in runs)


def resampled(docs, target, longest, buckets, percent, least):
    words = [[w.lower() if w.isascii() else w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))] for _, t in docs]
    other = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in target]

    def features(ws):
        return [zlib.crc32(" ".join(ws[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    s, t = Counter(f for w in words for f in features(w)), Counter(f for w in other for f in features(w))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for (i, _), w in zip(docs, words):
        weight = sum(math.floor(1000 * math.log((t[f] + 1) * (s_all + buckets) / ((s[f] + 1) * (t_all + buckets)))) for f in features(w))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest,buckets,percent,least", [(1, 10_000, 10, 20), (2, 97, 35, 3), (1, 50, 100, 0), (1, 50, 1, 500)])
def test_resampling_against_brute_force(spark, monkeypatch, longest, buckets, percent, least):
    monkeypatch.setattr(draws, "kth_key", lambda keyed, k, known=draws.kth_key: known(keyed, k, pivots=3, few=4))
    rng = random.Random(buckets)
    docs = [(i if i % 9 else None, sentence(rng, rng.randint(0, 60))) for i in range(300)]
    docs += [(400, docs[5][1])] * 40 + [(401, None), (402, ""), (2**63 - 1, docs[1][1]), (-(2**63), docs[1][1])]
    target = [sentence(rng, 30), None, "", docs[5][1]]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("row", F.lit("x")).repartition(7)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = draws.importance_resample(a, b, longest=longest, buckets=buckets, percent=percent, least_words=least).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled(docs, target, longest, buckets, percent, least)


def test_every_rank_of_a_quickselect(spark):
    rng = random.Random(4)
    rows = [(rng.choice([5, 6, 7]), rng.choice([None, 1, 2]), 3, 4, i) for i in range(150)]
    df = spark.createDataFrame(rows, "score long, doc_id long, n_features long, weight long, row long")
    keyed = df.select(draws.composite(df).alias("key")).cache()
    order = sorted((-s, int(d is None), d or 0, n, w, r) for s, d, n, w, r in rows)
    for k in (1, 2, 40, 75, 149, 150):
        assert draws.kth_key(keyed, k, pivots=2, few=3, seed=k) == order[k - 1]
    assert draws.kth_key(keyed, 0) is None and draws.kth_key(keyed, 151) is None
    assert draws.kth_key(keyed.filter("false"), 1) is None


def test_drawn_documents_keep_their_columns(spark, sf):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    drawn = draws.resampled(docs, target)
    ranks = QUERIES["op12_importance_quickselect"](spark, sf).filter("rank IS NOT NULL")
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in ranks.collect())


# --- top-k search -------------------------------------------------------------------------


def plain_top(ids, vectors, query_id, query, k):
    rows = [(sum(int(a) * int(b) for a, b in zip(v, query)), i) for i, v in zip(ids, vectors) if i != query_id and len(v) == len(query)]
    return [(i, s) for s, i in sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.sampled_from([1, 2, 9, 2**20, 2**40]), st.integers(1, 7), st.integers(0, 10**6))
def test_lists_against_brute_force(n, dims, size, k, seed):
    rng = random.Random(seed)
    vectors = np.array([[rng.randint(-size, size) for _ in range(dims)] for _ in range(n)], np.int64)
    ids = np.array(sorted(rng.choices(range(40), k=n)))
    lists = topk.SortedLists(ids, vectors)
    for _ in range(4):
        query = vectors[rng.randrange(n)] if rng.random() < 0.7 else np.array([rng.randint(-2, 2) for _ in range(dims)])
        own = int(ids[rng.randrange(n)])
        rows, scores, _ = lists.top(query, k, (int(np.searchsorted(ids, own)), int(np.searchsorted(ids, own, "right"))))
        assert [(int(ids[r]), s) for r, s in zip(rows, scores)] == plain_top(ids.tolist(), vectors, own, query, k)


def test_reading_stops_where_the_bound_allows():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(20_000, 3)) * 256).astype(np.int64)
    lists = topk.SortedLists(np.arange(20_000), vectors)
    read = [lists.top(v, 5, (i, i + 1))[2] for i, v in enumerate(vectors[:50])]
    assert np.mean(read) < 2_000


def test_search_on_edge_vectors(spark, edge_dir):
    from tests.llm.conftest import vectors

    rows = [(i, [math.floor(256 * np.float32(x).astype(float)) for x in v]) for i, v, *_ in vectors() if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {(i, tuple(v)) for i, v in rows if i is not None and i % 50 == 0}
    want = [(i, k + 1, j, s) for i, q in queries for k, (j, s) in enumerate(plain_top([r[0] for r in rows], [r[1] for r in rows], i, q, 5))]
    got = [tuple(r) for r in QUERIES["op13_threshold_topk"](spark, edge_dir["edge"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert QUERIES["op13_threshold_topk"](spark, edge_dir["empty"]).count() == 0


def test_blocks_and_doubles(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, 3, 25).collect())
    ints = [[math.floor(256 * x) for x in v] for _, v in rows]
    assert got == sorted((i, k + 1, j, s) for i in range(0, 500, 25) for k, (j, s) in enumerate(plain_top(range(500), ints, i, ints[i], 3)))
