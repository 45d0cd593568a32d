"""Resampling of documents towards a target distribution, drawn by a distributed quickselect.

*Scores.*  Features are runs of consecutive words, hashed into buckets.  A bucket's gain is the
scaled log ratio of its smoothed shares in the target and in the corpus; a document's weight
is the sum of the gains of its features, read from one array of gains.  Gumbel noise from a
hash of the id turns the k highest scores into a draw without replacement, proportional to
exp(weight).

*Draw.*  Rows get a composite key: higher score, smaller id, and further columns down to the
number of the stored row, so that no two keys are equal.  Random pivot keys of the open range
split it; exact counts below, at and above them tell where the k-th key lies, and the range
narrows to it until so few keys are open that they are read.  Only pivots, their counts and
at most ``FEW`` keys reach the driver.  Winners alone are sorted by range and ranked, with one
offset for each range.

Words are maximal runs of 0-9, a-z and characters above ASCII, after lower-casing A-Z only.
Null texts have none.  Documents with fewer than ``least_words`` words are scored but never
drawn; a null id hashes as ``<seed>:`` and loses ties to any id.  Repeated rows are separate
documents, and of rows alike in all columns as many are drawn as find a place.  Corpus counts
cover all rows.  An empty corpus gives an empty result; an empty target has no counts, so that
gains follow from smoothing alone.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import saved, slices, table, utf8

SCALE = 1000
#: Pivots of a round, and open keys that end the narrowing.
PIVOTS, FEW = 31, 1024
#: Bytes of a text that become word objects at once, and words whose buckets a task remembers.
PIECE, MEMORY = 1 << 20, 1 << 20
_KEY = ("down", "absent", "id", "n_features", "weight", "row")
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """Feature bytes to bucket; bounded, since the vocabulary grows with the data."""

    def __init__(self, number: int):
        super().__init__()
        self.number = number

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.number
        return bucket


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``PIECE`` bytes."""
    text = text.translate(_WORDS)
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + PIECE)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


def feature_buckets(text: bytes, longest: int, known: Buckets) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to ``longest`` words, in arrays, and each array's words as its first length."""
    held: list[bytes] = []
    for words in word_lists(text):
        found = [known[w] for w in words]
        both = held + words
        for n in range(2, longest + 1):
            found += [known[b" ".join(both[k: k + n])] for k in range(max(0, len(held) - n + 1), len(both) - n + 1)]
        held = both[max(0, len(both) - longest + 1):] if longest > 1 else []
        yield np.array(found, np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, ends = utf8(batch)
    raw = data.tobytes()
    for a, b in zip(ends.tolist(), ends.tolist()[1:]):
        yield raw[a:b]


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features in every bucket over all rows; a task sends one row for each of its buckets."""

    def task(batches):
        known, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in _rows(batch):
                for found in feature_buckets(text, longest, known):
                    counts += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most one row a bucket
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln of smoothed target share / smoothed corpus share) of every bucket."""
    number, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(SCALE * math.log((t + 1.0) * (s_all + number) / ((s + 1.0) * (t_all + number))))
                     for s, t in zip(corpus.astype(np.float64).tolist(), target.astype(np.float64).tolist())], np.int64)


def scored(docs: DataFrame, gains: np.ndarray, longest: int, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document; docs has doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def task(batches):
        own = shared.value
        known = Buckets(len(own))
        for batch in slices(batches):
            n_words, n_features, weights = [], [], []
            for text in _rows(batch):
                n = weight = 0
                for found in feature_buckets(text, longest, known):
                    n += len(found)
                    weight += int(own[found].sum())
                n_features.append(n)
                weights.append(weight)
                n_words.append(n if longest == 1 else sum(map(len, word_lists(text))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))], names=["doc_id", "n_words", "n_features", "weight"])

    made = docs.mapInArrow(task, "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return made.withColumn("score", F.col("weight") + F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def composite(rows: DataFrame) -> Column:
    """A key that is smaller the sooner a row is drawn."""
    return F.struct((-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("int").alias("absent"), F.coalesce("doc_id", F.lit(0)).alias("id"), "n_features", "weight", "row")


def _literal(key: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("int" if name == "absent" else "long").alias(name) for name, v in zip(_KEY, key)])


def kth_key(keyed: DataFrame, k: int, pivots: int = PIVOTS, few: int = FEW, seed: int = 0) -> tuple | None:
    """The k-th smallest (from 1) value of the distinct keys in column ``key``; None if there are fewer or k is 0.

    Every round counts the open rows exactly around random pivots.  When a quarter or less of
    the rows that are read is open, those are stored, so that later rounds read no others.
    """
    total = open_rows = keyed.count()
    if not 1 <= k <= total:
        return None
    current, at = keyed, seed
    while open_rows > few:
        at += 1
        drawn = sorted(tuple(r[0]) for r in current.orderBy(F.xxhash64(F.col("key.row"), F.lit(at)), "key").limit(pivots).select("key").collect())
        # 2 i is the gap below pivot i, 2 i + 1 the pivot itself
        place = sum((F.when(F.col("key") > _literal(p), 2).when(F.col("key") == _literal(p), 1).otherwise(0) for p in drawn), F.lit(0))
        counts = dict(current.groupBy(place.alias("place")).count().collect())
        ends = np.cumsum([counts.get(i, 0) for i in range(2 * len(drawn) + 1)]).tolist()
        gap = bisect_right(ends, k - 1)
        if gap % 2:
            return drawn[gap // 2]
        k -= ends[gap - 1] if gap else 0
        open_rows = counts[gap]
        if gap:
            current = current.filter(F.col("key") > _literal(drawn[gap // 2 - 1]))
        if gap // 2 < len(drawn):
            current = current.filter(F.col("key") < _literal(drawn[gap // 2]))
        if 4 * open_rows <= total:
            current = saved(current)
            total = open_rows
    return sorted(tuple(r[0]) for r in current.select("key").collect())[k - 1]


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with the rank of their ``key``: sorted by range, and an offset for each range."""
    parts = int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(f"key.{c}") for c in _KEY]
    placed = saved(winners.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
                   .withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at") - F.shiftleft("part", 33)))
    offsets, before = [], 0
    for part, n in sorted(placed.groupBy("part").count().collect()):  # one row a range
        offsets.append((part, before))
        before += n
    known = winners.sparkSession.createDataFrame(offsets, "part long, before long")
    return placed.join(F.broadcast(known), "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("part", "at", "before")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1,
                        buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    Of the N documents with ``least_words`` words, floor(percent * N / 100) are drawn.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    target = target.select(F.col(target_text).alias("text"))
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = saved(scored(docs, gains, longest, seed).withColumn("row", F.monotonically_increasing_id()))
    able = rows.filter(F.col("n_words") >= least_words)
    keyed = able.select(composite(rows).alias("key"))
    last = kth_key(keyed, percent * able.count() // 100)
    out = ("doc_id", "n_features", "weight", "score")
    if last is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = F.coalesce((F.col("n_words") >= least_words) & (composite(rows) <= _literal(last)), F.lit(False))
    winners = ranked(rows.filter(drawn).select(composite(rows).alias("key"), *out))
    return winners.select(*out, "rank").unionByName(rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns; rows of a drawn id stay together."""
    ranks = importance_resample(docs, target, id_col, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ranks, docs[id_col].cast("long").eqNullSafe(ranks["_drawn"]), "left_semi")


def op12_importance_quickselect(spark, sf_dir) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The table of CRC-32 remainders comes from its rule: eight shifts of every byte value.
ORACLE = r"""
WITH RECURSIVE step AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
word AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda j: ('0x' || hex(w)[2 * j + 1:2 * j + 2])::BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS k FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT k, count(*) AS n FROM dw JOIN word USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN word USING (w) GROUP BY k),
g AS (
  SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
x AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN word USING (w) JOIN g USING (k) GROUP BY r),
y AS (
  SELECT doc_id, r, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN x USING (r)),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight, r) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)
"""
