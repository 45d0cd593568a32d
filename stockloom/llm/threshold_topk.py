"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors become integers, ``floor(256 * x)``.  They are dealt out evenly into blocks of at most
``BLOCK_ROWS`` rows; a block keeps, for every dimension, the list of its rows sorted by that
component.  Queries pass through the blocks as rows of the same shuffle, never as a
broadcast, so a task holds one block and one Arrow batch of queries.

A query reads a list from the end that its component favours.  Rows not met yet score at
most the sum of the contributions at the depths reached; a row that is met is scored whole.
Which list to read on is chosen by how far its next stretch lowers that bound for each row
read, so that lists of small components are hardly read.  Reading stops when the bound is
below the k-th score (not at it, since an unmet row could tie and have a smaller id), or
when every row has been met.  The blocks' winners meet in one window per query.

How early a query stops depends on the data: where single dimensions say little about the
score, as for directions spread evenly over many dimensions, the bound falls slowly and most
rows are met before it does.

A vector takes no part if it is null, holds a null or non-finite component, or one whose
256-fold is no long.  Only vectors of a query's length are its candidates.  Rows with the
query's id are its own.  A repeated row is a candidate each time; as a query it is asked once,
and rows of one id with different vectors are queries of their own that report the same id.
A null id is no query and loses ties.  A score beyond long raises.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import saved, table

SCALE = 256
#: Rows whose lists a task holds: about 1 KB each at 64 dimensions.
BLOCK_ROWS = 1 << 17
#: Ratio of the depths at which the bound is known.
LEVEL = 1.3
#: Rows of the lists that a query reads before it looks at the bound for the first time.
FIRST_READ = 64


class SortedLists:
    """The rows of a block, in order of their ids, with a sorted list for every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        """``ids`` ascend; ``vectors`` are integers, one row each."""
        self.ids, self.rows = ids, len(ids)
        self.most = int(max(abs(int(vectors.max())), abs(int(vectors.min())))) if vectors.size else 0
        self.vectors = vectors.astype(next(t for t in (np.int16, np.int32, np.int64) if self.most <= np.iinfo(t).max or t is np.int64))
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)
        depths, at = [0, self.rows], 1.0
        while at < self.rows:
            depths.append(int(at))
            at = max(at + 1, at * LEVEL)
        self.depths = np.unique(depths)
        # the best value of rows below a depth, from the top and from the bottom; the last depth leaves no row
        top = np.minimum(self.depths, self.rows - 1)
        dims = np.arange(self.order.shape[0])[:, None]
        self.falling = self.vectors[self.order[:, self.rows - 1 - top], dims]
        self.rising = self.vectors[self.order[:, top], dims]

    def _number(self, query: np.ndarray):
        """Doubles where all sums are exact in them, else Python's integers."""
        size = max(1, len(query)) * (self.most + 1) * (max((abs(int(x)) for x in query), default=0) + 1)
        return np.float64 if size < 2**52 else object

    def top(self, query: np.ndarray, k: int, own: tuple[int, int]) -> tuple[np.ndarray, list[int], int]:
        """Rows and scores of the k best, ties to earlier rows, and how many rows were scored; rows from ``own[0]`` to ``own[1]`` are left out."""
        number = self._number(query)
        seen = np.zeros(self.rows, bool)
        seen[own[0]: own[1]] = True
        left = scored = self.rows - (own[1] - own[0])
        best, scores = np.zeros(0, np.int64), np.zeros(0, number)
        used = np.flatnonzero(query)
        if not len(used):  # every row scores 0, and the earliest win
            return np.flatnonzero(~seen)[:k], [0] * min(k, left), 0
        q = query[used].astype(number)
        up = query[used] > 0
        bounds = np.where(up[:, None], self.falling[used], self.rising[used]).astype(number) * q[:, None]
        drops = bounds[:, :-1] - bounds[:, 1:]
        width = np.diff(self.depths)
        # a stretch is read after those above it, so its gain counts as theirs at most
        gain = np.minimum.accumulate(drops.astype(np.float64) / width, axis=1)
        stretches = np.argsort(-gain, axis=None, kind="stable")
        lists, levels = np.divmod(stretches, len(width))
        bound = bounds[:, 0].sum() - np.cumsum(drops.reshape(-1)[stretches])
        read = np.cumsum(width[levels])
        depth, done, most = np.zeros(len(used), np.int64), 0, FIRST_READ
        while left and done < len(stretches):
            until = max(done + 1, int(np.searchsorted(read, most, "right")))
            if len(best) >= k:
                until = min(until, 1 + int(np.searchsorted(-bound, -scores[-1], "right")))
            until = min(until, len(stretches))
            reach = depth + np.bincount(lists[done:until], minlength=len(used))
            found = np.zeros(self.rows, bool)
            for i in np.flatnonzero(reach > depth):
                a, b = self.depths[depth[i]], self.depths[reach[i]]
                found[self.order[used[i], self.rows - b: self.rows - a] if up[i] else self.order[used[i], a:b]] = True
            new = np.flatnonzero(found & ~seen)
            seen |= found
            left -= len(new)
            best, scores = self._better(best, scores, new, self.vectors[new][:, used].astype(number) @ q, k)
            depth, done, most = reach, until, 4 * int(read[until - 1])
            if len(best) >= k and bound[done - 1] < scores[-1]:
                break
        return best, [int(s) for s in scores], scored - left

    @staticmethod
    def _better(best, scores, new, more, k):
        rows, all_scores = np.concatenate([best, new]), np.concatenate([scores, more])
        if len(rows) > k:
            least = np.partition(all_scores, len(rows) - k)[len(rows) - k]
            held = np.flatnonzero(all_scores >= least)
            rows, all_scores = rows[held], all_scores[held]
        by = np.argsort(rows, kind="stable")
        by = by[np.argsort(-all_scores[by], kind="stable")][:k]
        return rows[by], all_scores[by]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """Stretches of one block, one vector length, and either rows or queries; columns block, dims, asks, ..."""
    for batch in batches:
        keys = np.stack([batch.column(i).cast(pa.int64()).to_numpy() for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield (int(keys[0, a]), int(keys[1, a])), bool(keys[2, a]), batch.slice(a, b - a)


def _vectors(part: pa.RecordBatch, dims: int) -> np.ndarray:
    return part.column(4).flatten().to_numpy().reshape(part.num_rows, dims)


def answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The winners of every query in every block; a block's rows come before its queries."""
    at, parts, lists, nulls = None, [], None, 0
    for key, asks, part in _groups(batches):
        if key != at:
            at, parts, lists = key, [], None
        if not asks:
            parts.append(part)
            continue
        if not parts:  # no row of this length
            continue
        if lists is None:
            ids = pa.concat_arrays([p.column(3) for p in parts])
            nulls = ids.null_count
            by = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            known = ids.drop_null().to_numpy()
            lists = SortedLists(np.concatenate([np.sort(known), np.zeros(nulls, np.int64)]), np.concatenate([_vectors(p, at[1]) for p in parts])[by])
        known = lists.ids[: lists.rows - nulls]
        numbers, ids = part.column(5).to_numpy(), part.column(3).to_numpy()
        out = []
        for number, query_id, query in zip(numbers.tolist(), ids.tolist(), _vectors(part, at[1])):
            own = int(np.searchsorted(known, query_id)), int(np.searchsorted(known, query_id, "right"))
            rows, scores, _ = lists.top(query, k, own)
            out += [(number, query_id, None if row >= len(known) else int(known[row]), score) for row, score in zip(rows.tolist(), scores)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["number", "query_id", "vec_id", "score"])


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of long) of the vectors that take part."""
    large = float(2**62 // SCALE)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x"))
    fine = F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= large))
    return plain.filter(fine).select("vec_id", F.transform("x", lambda x: F.floor(x * float(SCALE))).alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row whose id is divisible by ``every``."""
    rows = saved(integer_vectors(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    queries = saved(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v").distinct().withColumn("number", F.monotonically_increasing_id()))
    # enough blocks for all tasks, and more where a block would be too large
    blocks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK_ROWS))
    held = rows.select(F.pmod("row", F.lit(blocks)).alias("block"), F.size("v").alias("dims"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("long").alias("number"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.size("v").alias("dims"), F.lit(True).alias("asks"), "vec_id", "v", "number")
    dealt = held.unionByName(asked).repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "dims", "asks")
    found = dealt.mapInArrow(lambda batches: answers(batches, k), "number long, query_id long, vec_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_threshold_topk(spark, sf_dir) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, v AS w FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, w, vec_id, list_inner_product(w, v)::BIGINT AS score FROM q JOIN v ON vec_id IS DISTINCT FROM query_id AND len(v) = len(w)),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
