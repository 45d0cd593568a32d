"""Language identification by nearest centroids of TF-IDF byte n-grams.

A text becomes hashed counts of the byte bigrams and trigrams of its lower-cased form, damped by
log(1 + count), weighted by inverse document frequency and normalised.  Every language has
``CENTROIDS`` centroids, fitted by spherical k-means on its training vectors.  A text gets
the language of the centroid with the largest cosine; each centroid also remembers the
distance that ``1 - REJECT`` of its training texts keep, and a text farther away is marked as
rejected (it keeps its nearest language in ``lang_pred``).

The fit takes at most ``SAMPLE`` labelled documents, as many of every language (at least one, should
there be more languages than that), those with the smallest hash of the id among the documents
with that label that training may use; so it does not depend on partitions, and a rare language
is learned as well.
Vectors, frequencies and centroids come from that sample; every whole document is scored.

Null texts and texts without a letter are ``und`` with score 0.  Without any labelled document
all are ``und``.  A null id is not held out and never trained on.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import map_slices, train_remainder, utf8

DIMENSIONS = 1 << 13
CENTROIDS = 3
SAMPLE = 3000
ROUNDS = 12
REJECT = 0.005
_FOLD = np.frombuffer(bytes(b + 32 if 65 <= b <= 90 else 0x20 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)), np.uint8)


def gram_counts(data: np.ndarray, rows: np.ndarray):
    """Hashed n-gram counts of every row, one at a time; runs of non-letters count as one space."""
    folded = _FOLD[data].astype(np.uint32)
    for a, b in zip(rows.tolist(), rows[1:].tolist()):
        x = folded[a:b]
        if len(x) > 1:
            x = x[np.concatenate([[True], (x[1:] != 0x20) | (x[:-1] != 0x20)])]
        pairs = x[:-1] * np.uint32(257) + x[1:]
        triples = pairs[:-1] * np.uint32(257) + x[2:] if len(x) > 2 else np.zeros(0, np.uint32)
        keys = np.concatenate([pairs, triples + np.uint32(7919)]) * np.uint32(2654435761) >> np.uint32(19)
        yield np.bincount(keys.astype(np.int64), minlength=DIMENSIONS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], limits: np.ndarray):
        self.idf, self.centroids, self.languages, self.limits = idf, centroids, languages, limits

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        norm = np.linalg.norm(v)
        return v / norm if norm else v


def _normal(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def fit(x: np.ndarray, languages: list[str]) -> Model | None:
    """Model from damped training counts (float32, one row per text), which are overwritten."""
    if not languages:
        return None
    seen = np.count_nonzero(x, axis=0)
    idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + np.float32(1)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.float32(1e-9))[:, None]
    names, centroids, limits = [], [], []
    labels = np.array(languages)
    for name in sorted(set(languages)):
        own = x[labels == name]
        k = min(CENTROIDS, len(own))
        # farthest-first start from the text nearest the mean
        first = int(np.argmax(own @ own.mean(axis=0)))
        picked, near = [first], own @ own[first]
        while len(picked) < k:
            picked.append(int(np.argmin(near)))
            near = np.maximum(near, own @ own[picked[-1]])
        c = own[picked]
        for _ in range(ROUNDS):
            owner = np.argmax(own @ c.T, axis=1)
            c = _normal(np.stack([own[owner == i].sum(axis=0) if (owner == i).any() else c[i] for i in range(k)]))
        cosine = own @ c.T
        owner = np.argmax(cosine, axis=1)
        for i in range(k):
            kept = cosine[owner == i, i]
            names.append(name)
            centroids.append(c[i])
            limits.append(np.quantile(kept, REJECT) if len(kept) else 1.0)
    return Model(idf, np.stack(centroids).astype(np.float32), names, np.array(limits))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2) -> Model | None:
    """Fit on a sample of every language: ``SAMPLE`` rows over all languages, evenly, and one of each at least.

    Ids come first, so that only sampled texts are turned into counts; of rows that repeat an id
    no more are taken.
    """
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fair = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (train_remainder(F.col("doc_id"), modulus) != held))
    each = max(1, SAMPLE // max(1, fair.select("lang").distinct().count()))
    first = lambda df, *order: df.withColumn("_rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", *order))).filter(F.col("_rn") <= each).drop("_rn")
    ids = first(fair.select("doc_id", "lang").distinct())

    def task(batch):
        kept, counts = [], []
        for text, lang, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), gram_counts(*utf8(batch))):
            if has_letter(text):
                kept.append(lang)
                hit = np.flatnonzero(own)
                counts.append(np.concatenate([hit, own[hit]]).astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(counts, pa.binary())], names=["lang", "counts"])

    # at most SAMPLE ids, or one a language, so the broadcast is bounded
    picked = first(fair.join(F.broadcast(ids), ["doc_id", "lang"]), F.xxhash64("text"))
    got = map_slices(picked.select("doc_id", "text", "lang"), task, "lang string, counts binary").toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(got.column("lang").to_pylist(), got.column("counts").to_pylist()))
    del got
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (_, packed) in enumerate(rows):
        hit, count = np.frombuffer(packed, np.uint32).reshape(2, -1)
        x[i, hit] = np.log1p(count.astype(np.float32))
    return fit(x, [lang for lang, _ in rows])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batch):
        own = shared.value
        names, scores, rejected = [], [], []
        for text, counts in zip(batch.column(1).to_pylist(), gram_counts(*utf8(batch))):
            if own is None or not has_letter(text):
                names.append("und")
                scores.append(0.0)
                rejected.append(True)
                continue
            cosine = own.centroids @ own.vector(counts)
            best = int(np.argmax(cosine))
            names.append(own.languages[best])
            scores.append(float(min(1.0, max(0.0, cosine[best]))))
            rejected.append(bool(cosine[best] < own.limits[best]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(plain, task, "doc_id long, lang_pred string, score double, rejected boolean")


def op4_centroid_language(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", F.coalesce(train_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
