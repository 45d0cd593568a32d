import random

import pytest

SYLLABLES = "the of and ing er re on an th ti st ha en ed ou ea hi is it or".split()


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


VECTORS = "vec_id long, embedding array<float>, label int, v string, block int, dims long, number string, rank long"


def vectors() -> list[tuple]:
    """Ties, repeated rows, nulls, non-finite components, several lengths, a zero and an empty vector, extreme ids."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) / 8 for _ in range(6)]) for i in range(120)]
    rows += [(7, rows[7][1])] * 3 + [(200, rows[7][1]), (250, [0.0] * 6), (300, [0.1, -0.2]), (301, [0.5, 0.25]), (350, []), (351, []), (400, [1.0])]
    rows += [(500, None), (501, [None, 0.1, 0.1, 0.1, 0.1, 0.1]), (550, [float("nan")] * 6), (551, [float("inf")] * 6), (None, [0.25] * 6), (None, rows[3][1])]
    rows += [(-50, rows[9][1]), (2**63 - 1, rows[10][1]), (-(2**63), [0.125] * 6), (600, [-1e-9] * 6), (650, [30000.0] * 6)]
    return [(*r, *[None] * 6) for r in rows]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    base = [sentence(rng, 40) for _ in range(12)]
    long = sentence(rng, 60_000)
    texts = [None, "", " ", "\n\t", "a", "é", "a b c d", "  a  b c d e  f ", "日本 語 x", long, "x" * 20_000, base[0], base[0], base[0].upper(), base[1], base[1] + " more", "12345 !!", *base]
    rows = [(i, t, None if i % 7 == 3 else "en", None if i % 5 == 2 else "src0", None if i % 4 == 1 else len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base[2], "en", "src1", 1), (None, None, None, None, None), (11, base[0], "en", "src0", 3), (11, base[3], "de", "src0", 3)]
    clash = "digest binary, n long, cid string, token string, sketch string, mix_topic string, score double, _key string, label string, size long, _digest string"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + clash
    full = [(*r, *[None] * 11) for r in rows]
    out = {}
    for name, data in (("edge", full), ("empty", [])):
        folder = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        labels = [(i, i % 2, 0) for i in range(20)] + [(3, None, 0), (None, 1, 0), (4, 1, 0)] if data else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        texts = [(1, base[0][:200]), (2, None), (3, ""), (None, base[1] + " " + base[1]), (2, "É " + base[5])] if data else []
        spark.createDataFrame([(*r, 1) for r in texts], "item_id long, text string, bucket long").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame(vectors() if data else [], VECTORS).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
        out[name] = folder
    return out
