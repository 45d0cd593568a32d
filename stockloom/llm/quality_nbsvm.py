"""Quality classifier: naive-Bayes-scaled support vectors.

A text becomes indicators of n-grams: windows of four character classes, n-grams of word
signs (case, mark behind the word, repetition of a recent word), and hashed word unigrams and
bigrams.  Every indicator is scaled by its log-count ratio between the classes, the vector
is normalised, and a linear hinge-loss model is fitted by dual coordinate descent.  Margins
become scores by a logistic curve fitted on the training margins.

The fit takes at most ``SAMPLE`` labelled documents, those with the smallest hash of the id
among the labelled documents that training may use, and at most ``MOST`` indicators of each;
ratios, weights and curve come from them.  Every whole document is scored.

Null and empty texts have no n-gram and get the score of the bias.  Without labels of both
classes every score is 0.5, which accepts.  Conflicting labels of one id count as
separate examples.  A null id is not held out and never trained on.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import hashed_words, map_slices, mix, train_remainder, utf8

SAMPLE = 8000
#: Indicators of a training row; longer texts give those of the least hashes.
MOST = 4096
EPOCHS = 25
COST = 1.0
ACCEPT = 0.3
HASHED = 1 << 15
_CLASSES, _SIGNS = 16**4, 16**3
DIMENSIONS = _CLASSES + _SIGNS + HASHED


def _byte_class(b: int) -> int:
    c = chr(b)
    if b >= 0x80 or c.islower():
        return 1
    if c.isupper():
        return 2
    if c.isdigit():
        return 3
    return {" ": 4, "\n": 5, ".": 6, ",": 7, "!": 8, "?": 9, "|": 10, "*": 11, "#": 12, "$": 13, "%": 14, "&": 14, "@": 15, "<": 15, ">": 15, "_": 15, "=": 15}.get(c, 0)


_CLASS = np.array([_byte_class(b) for b in range(256)], np.uint32)
_WORD = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


def indicator_rows(data: np.ndarray, rows: np.ndarray):
    """Sorted numbers of the n-grams that occur, row by row."""
    classes = _CLASS[data]
    quads = classes[:-3] * 4096 + classes[1:-2] * 256 + classes[2:-1] * 16 + classes[3:] if len(classes) > 3 else np.zeros(0, np.uint32)
    hashes, starts, firsts = hashed_words(data, rows, _WORD)
    n = len(hashes)
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(firsts))
    # sign of a word: case of its first and second letter, mark at its end, repetition within eight words
    ends = np.empty(n, np.int64)
    if n:
        ends[:-1], ends[-1] = starts[1:] - 1, len(data) - 1
        ends = np.minimum(ends, rows[1:][row_of] - 1)
        space = ~_WORD[data[ends]]
        ends = ends - space
    first, second = classes[starts], classes[np.minimum(starts + 1, np.maximum(ends, starts))] if n else classes[:0]
    last = classes[ends] if n else classes[:0]
    signs = (first == 2).astype(np.uint32) * ((second == 2) + np.uint32(1)) + 3 * (last > 7)
    repeated = np.zeros(n, bool)
    for back in range(1, 9):
        repeated[back:] |= (hashes[back:] == hashes[:-back]) & (row_of[back:] == row_of[:-back])
    signs = signs + 8 * repeated
    grams = signs.copy()
    grams[2:] = signs[2:] * 256 + signs[1:-1] * 16 + signs[:-2]
    pairs = np.zeros(n, np.uint64)
    pairs[1:] = mix(hashes[1:] + hashes[:-1] * np.uint64(3))
    words = np.stack([hashes, pairs]) % np.uint64(HASHED)
    flags = np.zeros(DIMENSIONS, bool)
    bounds = rows.tolist()
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        i, j = firsts[k], firsts[k + 1]
        flags[quads[a: max(a, b - 3)]] = True
        flags[_CLASSES + grams[min(j, i + 2): j]] = True
        flags[_CLASSES + _SIGNS + words[0, i:j].astype(np.int64)] = True
        flags[_CLASSES + _SIGNS + words[1, min(j, i + 1): j].astype(np.int64)] = True
        hit = np.flatnonzero(flags)
        flags[hit] = False
        yield hit


class Model:
    """``weights`` hold ratio and coefficient in one; ``bias``, ``slope`` and ``shift`` make scores of margins."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.squares, self.bias, self.slope, self.shift = weights, ratios**2, bias, slope, shift

    def margin(self, hit: np.ndarray) -> float:
        norm = np.sqrt(self.squares[hit].sum())
        return float(self.weights[hit].sum() / norm if norm else 0.0) + self.bias

    def score(self, hit: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(hit) + self.shift, -30, 30))))


def _descend(x: list[np.ndarray], ratios: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss, each class with half of the total cost; the bias is a feature of value one."""
    share = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * COST
    values = []
    for hit in x:
        v = ratios[hit]
        norm = np.linalg.norm(v)
        values.append(v / norm if norm else v)
    square = np.array([v @ v for v in values]) + 1
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(y))
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(y)):
            slope = y[i] * (w[x[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, classes weighted alike."""
    t = (y > 0).astype(float) * 0.98 + 0.01
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    x, beta = np.stack([margins, np.ones(len(y))], axis=1), np.array([2.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-6
        beta -= np.linalg.solve(h, x.T @ (weight * (p - t)))
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(x: list[np.ndarray], labels: np.ndarray) -> Model | None:
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return None
    counts = np.ones((2, DIMENSIONS))
    for hit, positive in zip(x, y > 0):
        counts[int(positive), hit] += 1
    shares = counts / np.array([[(y < 0).sum() + 2.0], [(y > 0).sum() + 2.0]])
    ratios = np.log(shares[1] / shares[0])
    w, bias = _descend(x, ratios, y)
    model = Model(w * ratios, ratios, bias, 1.0, 0.0)
    model.slope, model.shift = _curve(np.array([model.margin(hit) for hit in x]), y)
    return model


def _few(hit: np.ndarray) -> np.ndarray:
    """At most ``MOST`` indicators of a training row, those of the least hashes."""
    if len(hit) <= MOST:
        return hit.astype(np.int32)
    return np.sort(hit[np.argsort(mix(hit.astype(np.uint64)), kind="stable")[:MOST]]).astype(np.int32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, held: int = 0) -> Model | None:
    """Fit on the sample of labelled documents whose id has another remainder than ``held``.

    At most ``SAMPLE`` labels, at most ``SAMPLE`` documents that carry them (an id may repeat), and
    at most ``MOST`` indicators of each reach the driver, whatever the texts are.
    """
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    fair = named.filter(train_remainder(F.col("doc_id"), modulus) != held).distinct()
    sample = fair.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)

    def task(batch):
        hits = [_few(h) for h in indicator_rows(*utf8(batch))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([h.tobytes() for h in hits], pa.binary())], names=["doc_id", "label", "hits"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # at most SAMPLE rows of two numbers, so the broadcast is bounded
    met = map_slices(plain.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label"), task, "doc_id long, label int, hits binary")
    got = met.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "hits").limit(SAMPLE).toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("label").to_pylist(), got.column("hits").to_pylist()))
    return fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batch):
        own = shared.value
        scores = np.array([own.score(hit) if own else 0.5 for hit in indicator_rows(*utf8(batch))])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(plain, task, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that the classifier accepts, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batch):
        own = shared.value
        return batch.filter(pa.array([own is None or own.score(hit) >= ACCEPT for hit in indicator_rows(*utf8(batch, text_col))], pa.bool_()))

    return map_slices(docs, task, docs.schema, text_col)


def op1_quality_nbsvm(spark, sf_dir) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).select("doc_id", F.coalesce(train_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
