"""Scores, labels and bounds of the trained operators against plain recomputation."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import centroid_language, licence_scan, quality_nbsvm, secret_crf, source_raking, trie_counts
from tests.llm.conftest import sentence

# --- secrets ------------------------------------------------------------------------------


def test_many_spans_take_linear_time(spark):
    rng = random.Random(1)
    lines = ["é " + "".join(rng.choice("0123456789abcdef") for _ in range(30)) + f" password = s3cr3t{i}xyz " + "AKIA" + "A1B2" * 5 for i in range(20_000)]
    text = "\n".join(lines)
    field = secret_crf.train(spark.createDataFrame([(1, "\n".join(lines[:50]))], "doc_id long, text string"))
    began = time.time()
    row = secret_crf.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).first()
    assert time.time() - began < 60
    assert (row.n_assign, row.n_access, row.n_hex) == (20_000, 20_000, 20_000)
    spans = [s.split(":") for s in row.spans.split(",")]
    hexes = [text[int(a):int(b)] for kind, a, b in spans if kind == "hex"]
    assert len(hexes) == 20_000 and all(len(h) == 30 and set(h) <= set("0123456789abcdef") for h in hexes)
    base = sorted((int(a), int(b)) for kind, a, b in spans if kind != "crf")
    reach = np.maximum.accumulate([b for _, b in base])
    for kind, a, b in spans:
        if kind == "crf":
            at = np.searchsorted([x for x, _ in base], int(b))
            assert at == 0 or reach[at - 1] <= int(a)


def test_gradient_of_the_field():
    """The likelihood of a path by enumeration agrees with the field's own decoding: no path scores higher than the best."""
    import itertools

    field = secret_crf.Field()
    rng = np.random.default_rng(2)
    field.moves[:] = rng.normal(size=field.moves.shape)
    e = rng.normal(size=(6, 3))
    best = field.best_path(e)

    def total(path):
        return sum(e[i, t] for i, t in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

    allowed = [p for p in itertools.product(range(3), repeat=6)]
    assert total(best) == pytest.approx(max(total(p) for p in allowed if np.isfinite(total(p))))


# --- token counts -------------------------------------------------------------------------


def test_long_words_share_no_trie(monkeypatch):
    import public_tokenizers

    scores = trie_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    own, rolled = trie_counts.Trie(scores), trie_counts.Trie(scores)
    rng = random.Random(5)
    for n in (1, 2, 7, 40, 300):
        word = trie_counts.MARK + "".join(rng.choice(["the", "日本", "é", "ing", "x", "🙂"]) for _ in range(n))
        assert rolled._rolled(word) == own._insert(word)
    long = "ab日" * 100_000
    before = len(rolled.best)
    assert rolled.count_of(long) > 0 and len(rolled.best) == before and long not in rolled.words


# --- quality ------------------------------------------------------------------------------


def test_scores_from_the_model_by_hand(spark):
    """A score is the logistic curve of the normalised, ratio-scaled indicators times the weights."""
    rng = random.Random(3)
    docs = [(i, sentence(rng, 30) if i % 2 else " ".join(w.upper() + "!!" for w in sentence(rng, 30).split())) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = quality_nbsvm.train(d, labels)
    got = {r.doc_id: r.score for r in quality_nbsvm.score(d, model).collect()}
    for i, text in docs[:40]:
        data = np.frombuffer(text.encode(), np.uint8)
        hit = next(iter(quality_nbsvm.indicator_rows(data, np.array([0, len(data)]))))
        norm = np.sqrt(model.squares[hit].sum())
        margin = (model.weights[hit].sum() / norm if norm else 0.0) + model.bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))), abs=1e-9)
    assert all((got[i] >= 0.5) == bool(i % 2) for i, _ in docs)


def test_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality_nbsvm, "SAMPLE", 10)
    seen = {}
    monkeypatch.setattr(quality_nbsvm, "fit", lambda x, y: seen.update(n=len(x)))
    rng = random.Random(4)
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5][:2]
    docs = spark.createDataFrame([(a, sentence(rng, 400)) for _ in range(100)] + [(b, sentence(rng, 400))], "doc_id long, text string")
    quality_nbsvm.train(docs, spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, quality int"))
    assert seen["n"] <= 10
    few = quality_nbsvm._few(np.arange(0, 10**5, 3))
    assert len(few) == quality_nbsvm.MOST and (np.diff(few) > 0).all() and set(few.tolist()) <= set(range(0, 10**5, 3))


# --- language -----------------------------------------------------------------------------


def test_language_scores_by_hand_and_rare_languages(spark):
    rng = random.Random(6)
    words = {"aa": "bado kemi lotu".split(), "bb": "strx vrkt plzz".split(), "cc": "ñuña çéla øre".split()}
    docs = []
    for i in range(900):
        lang = "cc" if i % 180 == 7 else "aa" if i % 2 else "bb"
        docs.append((i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = centroid_language.train(df)
    assert set(model.languages) == set(words)
    got = {r.doc_id: r for r in centroid_language.predict(df, model).collect()}
    for i, text, lang in docs:
        assert got[i].lang_pred == lang
    for i, text, lang in docs[:30]:
        counts = next(iter(centroid_language.gram_counts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))))
        v = np.log1p(counts) * model.idf
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert got[i].score == pytest.approx(float(np.clip(cosine.max(), 0, 1)), abs=1e-5)


def test_sample_is_even_over_languages(spark, monkeypatch):
    monkeypatch.setattr(centroid_language, "SAMPLE", 30)
    seen = {}
    monkeypatch.setattr(centroid_language, "fit", lambda x, langs: seen.update({k: langs.count(k) for k in langs}))
    own = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = [(i, "abc def", "big") for i in range(500)] + [(1000 + i, "xyz", "small") for i in range(6)] + [(own, "abc", "hot") for _ in range(200)]
    centroid_language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert seen["big"] == 10 and 1 <= seen["small"] <= 6 and seen["hot"] == 10


# --- licences -----------------------------------------------------------------------------


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(3, len(words) - 3)
        words[at] = rng.choice(["kindly", "whatsoever", "thereof"])
    return " ".join(words)


@pytest.mark.parametrize("label", sorted(licence_scan.TEMPLATES))
def test_edited_notices_are_labelled(spark, label):
    rng = random.Random(label)
    words = licence_scan.TEMPLATES[label].split()
    edits = max(1, len(words) // 20)
    texts = [edited(rng, words, edits) for _ in range(8)]
    df = spark.createDataFrame([(i, sentence(rng, 20) + " " + t + " " + sentence(rng, 20)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [r.labels.split(",") for r in licence_scan.scan(df).collect()]
    assert sum(label in f for f in found) >= 7


def test_a_reworded_notice_keeps_one_chain(spark):
    text = ("Redistribution and use in source and binary form are permitted provided that the following conditions are met: Redistributions of source code must keep the above "
            "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must show the above copyright notice, this list of "
            "conditions and the following disclaimer within the documentation and/or other materials provided with the distribution.")
    row = licence_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert "bsd-3-clause" in row.labels.split(",")


def test_chains_against_all_chains():
    import itertools

    own = licence_scan.Scanner({"a": "one two three four five six seven eight nine ten eleven twelve"}, {})
    rng = random.Random(8)
    for _ in range(300):
        matches = []
        for _ in range(rng.randint(1, 6)):
            start, t, n = rng.randint(0, 30), rng.randint(0, 8), rng.randint(1, 4)
            matches.append((0, start, start + n, t, t + n))
        matches = sorted(set(matches))
        best = 0
        for k in range(1, len(matches) + 1):
            for chain in itertools.combinations(matches, k):
                if all(b[1] - a[2] <= licence_scan.GAP_WORDS and b[4] > a[4] and b[2] > a[2] for a, b in zip(chain, chain[1:])):
                    covered = chain[0][4] - chain[0][3]
                    for a, b in zip(chain, chain[1:]):
                        covered += b[4] - max(a[4], b[3])
                    best = max(best, covered)
        assert max(c[3] for c in own.chains(list(matches))) * own.sizes[0] == pytest.approx(best)


# --- mixing -------------------------------------------------------------------------------


def test_targets_of_the_caller_and_the_gap(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 20), rng.choice(["en", "fr"]), rng.choice(["a", "a", "a", "b"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wish = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("other", 9.0)], "value string, share double")
    out = source_raking.mix(docs, targets={"mix_source": wish}).collect()
    assert all(r.mix_gap < 1e-9 for r in out)
    mass = {x: sum(r.mix_tokens * r.mix_factor for r in out if r.source == x) for x in "ab"}
    assert mass["a"] == pytest.approx(mass["b"], rel=1e-6)
    # a source of one language only cannot meet contradicting shares of both
    lone = spark.createDataFrame([(i, "x y z", "en" if i % 2 else "fr", "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, lang string, source string")
    clash = {"mix_source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, share double"), "mix_lang": spark.createDataFrame([("en", 0.1), ("fr", 0.9)], "value string, share double")}
    assert source_raking.mix(lone, targets=clash).first().mix_gap > 0.1
    with pytest.raises(ValueError):
        source_raking.mix(lone, targets=clash, most_gap=0.01)
