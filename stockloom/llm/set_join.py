"""Jaccard self-join on word shingles with skipping inside lists and between answers.

Two documents link when 100 * |A ∩ B| >= 75 * |A ∪ B|, over distinct 64-bit hashes of
five-word shingles.  The result is the component of every document.

*Classes.*  Documents of equal sets are one class (a 128-bit digest of the set); only classes
are compared, so copies are never expanded into pairs.

*Lists.*  Shingles are ordered: those outside a set of very frequent ones first, each part by
a second hash.  Two linked sets share a shingle among the first ``floor(n / 4) + 1`` of both.
Of large sets far fewer suffice.  At most n / 4 of n shingles are not common to a linked set,
so of a part of u shingles, each that comes first is common with a chance of at least
``1 - n / (4 u)``, and the first ``MISS / ln(4 u / n)`` miss a link with a chance below
exp(-MISS) ~ 1e-14, that of a collision of hashes.  That many are kept of the part that has
half of the set or more, after all of a smaller part before it.  The bound holds whatever the
texts are and however often they occur: which shingles are frequent follows from the texts
and ids sampled, and the order inside a part from the second hash alone.  ``miss=None`` keeps the whole
prefix, at about three times the rows.

*Skipping between answers.*  In every long list the members are first compared with one pivot, the
member whose lists are the longest on average, which stands in the middle of a group of copies.  The
links found so contract near copies into clusters; members of one cluster have their answer
and are not compared again.  Jaccard distance is a metric, so two members whose distances to
the pivot differ by more than 0.25 are skipped as well.

*Skipping inside lists.*  A linked pair meets at its first common shingle, and there all that
stands before it is not shared: with position p of n shingles, a partner has at most
(4 n - 7 p) / 3.  So the rest of a list is joined in blocks of set size, and a member only
visits the blocks that its position leaves; far positions, as those of passages that many
documents share, visit none.  Pairs whose last two shingles before the position have one in
common have met already.  A parity bitmap of 512 bits bounds the symmetric difference
from below and drops pairs without reading their sets.  What remains is verified on the
whole sets.

Frequent shingles are those that at least ``max(HOT_ROWS, rows / MAX_HOT)`` of the documents of
a sample (one in ``SAMPLED``, by hash of the id) hold, hence at most ``MAX_HOT``.  They only
decide the order of the lists, and so the cost, never the links.

Null and empty texts, and texts without words, have an empty set and link with
nothing.  Texts of fewer than five words have one shingle, their whole sequence.  Rows of one
id are separate documents that report the same smallest id if linked; a null id never names
a component unless all its ids are null.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import hashed_words, map_slices, mix, saved, utf8
from stockloom.llm.components import components

WIDTH = 5
MISS = 32.0
#: One in so many documents is counted to find frequent shingles, and how many of the counted ones hold such a shingle.
SAMPLED, HOT_ROWS = 16, 3
#: Members of a list that has a pivot; in shorter ones all members may meet, once the clusters are known.
PIVOT_FROM = 16
#: Ratio of the sizes in a block of a list.
BLOCK = 1.05
MAX_HOT = 1_000_000
#: Bits of the filter that tells a verification scan which documents to open; wrong hits only cost time.
DOOR_BITS = 1 << 26
_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_TURNS = mix(np.arange(1, WIDTH + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Turns the first hash of a shingle into the second, which orders the lists.
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_BITS = [f"b{i}" for i in range(8)]


def shingle_sets(data: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    words, _, firsts = hashed_words(data, rows, _WORD)
    n = max(0, len(words) - WIDTH + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        grams += words[k: k + n] * _TURNS[k]
    grams = mix(grams)
    out = []
    bounds = firsts.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= WIDTH:
            out.append(np.unique(grams[a: b - WIDTH + 1]))
        elif b > a:
            own = words[a:b]
            out.append(mix((own * _TURNS[: b - a]).sum(dtype=np.uint64, keepdims=True) + _TURNS[WIDTH:] * np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int, rare: int, miss: float | None = MISS) -> int:
    """How many shingles of a set of n, of them ``rare`` not frequent, its lists need."""
    if n == 0 or miss is None:
        return n and n // 4 + 1
    before, part = (0, rare) if 2 * rare >= n else (rare, n - rare)
    return min(n // 4 + 1, before + math.ceil(miss / math.log(4 * part / n)))


def class_id(values: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    sums = np.array([mix(values).sum(dtype=np.uint64), mix(values ^ _TURNS[0]).sum(dtype=np.uint64)], np.uint64)
    return mix(sums + _TURNS[1:3] * np.uint64(len(values))).tobytes()


def _least(values: np.ndarray, k: int) -> np.ndarray:
    """The k smallest, sorted."""
    return np.sort(np.partition(values, k)[:k] if k < len(values) else values)


def ordered_prefix(values: np.ndarray, hot: np.ndarray, miss: float | None = MISS) -> np.ndarray:
    """Second hashes of the first shingles of a set (of first hashes), frequent ones last."""
    order = mix(values ^ _SECOND)
    frequent = np.zeros(len(values), bool)
    if len(hot):
        frequent = hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values
    rare = int(len(values) - frequent.sum())
    k = prefix_size(len(values), rare, miss)
    first = _least(order[~frequent], min(k, rare))
    return first if rare >= k else np.concatenate([first, _least(order[frequent], k - rare)])


def parity_bitmap(values: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((values & np.uint64(511)).astype(np.int64), minlength=512) & 1).view(np.int64)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that several documents of a sample hold, at most ``MAX_HOT`` of them."""

    def task(batch):
        values = shingle_sets(*utf8(batch))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64))], names=["token"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    counts = saved(map_slices(sample, task, "token long").groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") >= HOT_ROWS))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    least = max(HOT_ROWS, math.ceil(total / MAX_HOT))
    found = counts.filter(F.col("rows") >= least).select("token").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def signatures(docs: DataFrame, hot: np.ndarray, miss: float | None = MISS) -> DataFrame:
    """doc_id, n, class, list prefix and bitmap of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def task(batch):
        sets = shingle_sets(*utf8(batch))
        bits = np.array([parity_bitmap(s) for s in sets])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_id(s) for s in sets], pa.binary()), _longs([ordered_prefix(s, shared.value, miss) for s in sets]),
             *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(8)]], names=["doc_id", "n", "cid", "sig", *_BITS])

    return map_slices(docs, task, "doc_id long, n long, cid binary, sig array<long>, " + ", ".join(f"{b} long" for b in _BITS))


def _door(ids: DataFrame) -> bytes:
    """A bitmap of hashed ids, of fixed size."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(DOOR_BITS))
    # the built-in bitmaps count values from one
    maps = ids.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m"))
    out = bytearray(DOOR_BITS // 8)
    for k, bits in maps.collect():
        out[(k - 1) * 4096: k * 4096] = bits
    return bytes(out)


def opened_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """class and whole set of the documents named (and of a few others)."""
    door = docs.sparkSession.sparkContext.broadcast(_door(ids))

    def task(batch):
        bits = batch.column(2).to_numpy()
        held = (np.frombuffer(door.value, np.uint8)[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
        batch = batch.filter(pa.array(held.astype(bool)))
        if not batch.num_rows:
            return None
        sets = shingle_sets(*utf8(batch))
        return pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.binary()), _longs(sets)], names=["cid", "shingles"])

    marked = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(DOOR_BITS)).alias("bit"))
    return map_slices(marked, task, "cid binary, shingles array<long>")


def _enough(common, a, b):
    """100 |A ∩ B| >= 75 |A ∪ B|."""
    return 100 * common >= 75 * (a + b - common)


def _block(n):
    """Number of the size block of n shingles."""
    return F.floor(F.log(n.cast("double")) / math.log(BLOCK)).cast("int")


def _bitmap_allows(left: str, right: str):
    apart = sum((F.bit_count(F.col(f"{left}.{b}").bitwiseXOR(F.col(f"{right}.{b}"))) for b in _BITS[1:]),
                F.bit_count(F.col(f"{left}.b0").bitwiseXOR(F.col(f"{right}.b0"))))
    # |A Δ B| >= apart, so |A ∩ B| <= (n + m - apart) / 2
    most = (F.col(f"{left}.n") + F.col(f"{right}.n") - apart) / 2
    return _enough(most, F.col(f"{left}.n"), F.col(f"{right}.n"))


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, common, n_a, n_b of the pairs that their bitmaps allow, from whole sets."""
    side = classes.select("cid", "n", "first_id", *_BITS)
    kept = saved(
        pairs.alias("p").join(side.alias("l"), F.col("p.a") == F.col("l.cid")).join(side.alias("r"), F.col("p.b") == F.col("r.cid"))
        .filter(_bitmap_allows("l", "r"))
        .select("a", "b", F.col("l.n").alias("n_a"), F.col("r.n").alias("n_b"), F.col("l.first_id").alias("id_a"), F.col("r.first_id").alias("id_b")))
    ids = kept.select(F.explode(F.array("id_a", "id_b")).alias("doc_id")).distinct()
    sets = saved(opened_sets(docs, ids))
    both = (kept.select("a", "b", "n_a", "n_b")
            .join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("s")), "a")
            .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("t")), "b"))
    return saved(both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s", "t")).cast("long").alias("common")).distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float | None = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = _plain(docs, id_col, text_col)
    marked = saved(signatures(docs, frequent_shingles(docs), miss))
    classes = saved(marked.filter("n > 0").groupBy("cid").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), *[F.first(b).alias(b) for b in _BITS]))

    # lists with their pivot; lists of one member have nothing to compare
    rows = classes.select("cid", "n", "sig", F.posexplode("sig").alias("pos", "token")).select(
        "cid", "n", F.size("sig").alias("lists"), "pos", "token", F.get("sig", F.col("pos") - 1).alias("p1"), F.get("sig", F.col("pos") - 2).alias("p2"))
    shared = rows.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1")
    met = saved(rows.join(shared, "token"))
    central = met.groupBy("cid").agg((F.sum("members") / F.first("lists")).alias("central"))
    pivots = met.select("token", "cid").join(central, "cid").groupBy("token").agg(F.max(F.struct("central", "cid")).alias("p")).select("token", F.col("p.cid").alias("pivot"))
    lists = saved(met.drop("lists").join(pivots, "token"))

    pivot_pairs = (lists.filter((F.col("members") >= PIVOT_FROM) & (F.col("cid") != F.col("pivot"))).select(F.col("cid").alias("a"), F.col("pivot").alias("b"), "n").distinct()
                   .join(classes.select(F.col("cid").alias("b"), F.col("n").alias("m")), "b").filter("3 * greatest(n, m) <= 4 * least(n, m)").select("a", "b"))
    compared = verified(docs, pivot_pairs, classes)
    linked = _enough(F.col("common"), F.col("n_a"), F.col("n_b"))
    clusters = components(compared.filter(linked).select("a", "b"))

    # what pivots left open: members of different clusters
    label = clusters.select(F.col("a").alias("cid"), F.col("b").alias("cluster"))
    labelled = lists.join(label, "cid", "left").withColumn("cluster", F.coalesce("cluster", "cid"))
    mixed = labelled.groupBy("token").agg(F.min("cluster").alias("c0"), F.max("cluster").alias("c1")).filter("c0 <> c1").select("token")
    distance = compared.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("apart"))
    open_rows = saved(
        labelled.join(mixed, "token").join(distance, ["cid", "pivot"], "left")
        .withColumn("apart", F.when(F.col("cid") == F.col("pivot"), 0.0).otherwise(F.col("apart")))
        .join(classes.select("cid", *_BITS), "cid"))
    most = F.floor((4 * F.col("n") - 7 * F.col("pos")) / 3)
    small = open_rows.withColumn("most", most).filter("most >= n").withColumn("block", F.explode(F.sequence(_block(F.col("n")), _block(F.col("most"))))).alias("l")
    large = open_rows.withColumn("block", _block(F.col("n"))).alias("r")
    rest = (
        small.join(large, (F.col("l.token") == F.col("r.token")) & (F.col("l.block") == F.col("r.block"))
                   & F.expr("l.cluster <> r.cluster AND (l.n < r.n OR l.n = r.n AND l.cid < r.cid) AND r.n <= l.most AND 3 * (l.n + r.n) <= 7 * (r.n - r.pos)")
                   & F.expr("NOT coalesce(l.p1 IN (r.p1, r.p2) OR l.p2 IN (r.p1, r.p2), false)")
                   & F.expr("l.apart IS NULL OR r.apart IS NULL OR abs(l.apart - r.apart) <= 0.2500001") & _bitmap_allows("l", "r"))
        .select(F.col("l.cid").alias("a"), F.col("r.cid").alias("b")).distinct())
    more = verified(docs, rest, classes)
    links = more.filter(linked).select("a", "b").unionByName(clusters.select("a", "b"))
    roots = components(links).select(F.col("a").alias("cid"), F.col("b").alias("root"))

    rooted = saved(classes.select("cid", "first_id").join(roots, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), "first_id"))
    names = saved(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = rooted.join(names, "root").select("cid", "component_id")
    alone = marked.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return marked.filter("n > 0").select("doc_id", "n", "cid").join(named, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op9_set_join(spark, sf_dir) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON r.a = p.a)
SELECT s.doc_id, len(g) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON s.doc_id = m.a
"""
