"""Exact deduplication over a cuckoo-filter index of live digests.

Every document becomes the SHA-256 of its text after lower-casing A-Z.  An index shard
holds the digests of its rows: a cuckoo filter answers "never seen" without touching the
content; a hit is verified against the bucketed content (full digest and byte length), so
that a false hit of the filter cannot merge two texts.  When a larger id arrives for a live
digest the former entry is deleted from the filter and the new one inserted.  An insertion
that finds no place after ``KICKS`` moves resizes the filter from the stored keys.

Input partitions pre-aggregate through a local index, so that a text that holds a third of
all rows sends one row per partition to its shard.  A shard holds only its distinct digests
(about 300 bytes each); size ``spark.sql.shuffle.partitions`` to bound it.

Null text counts as empty; rows of equal id and equal text are counted, and the id that
stays is reported once per row.  A null id loses to every other id; a group of null ids has a
null ``keep_id``.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from stockloom.llm.common import LOWER_TABLE, map_slices, saved, utf8

SLOTS = 4
KICKS = 256


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each in one of two buckets."""

    def __init__(self, buckets: int = 64):
        self.buckets = buckets
        self.cells = array("H", bytes(2 * SLOTS * buckets))
        self.turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _slot(self, bucket: int, mark: int) -> int:
        cells, at = self.cells, bucket * SLOTS
        for slot in range(at, at + SLOTS):
            if cells[slot] == mark:
                return slot
        return -1

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return self._slot(a, mark) >= 0 or self._slot(b, mark) >= 0

    def insert(self, digest: bytes) -> bool:
        """False when the filter is too full; the fingerprint moved last is then missing, so it must be resized."""
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            slot = self._slot(bucket, 0)
            if slot >= 0:
                self.cells[slot] = mark
                return True
        bucket = b
        for _ in range(KICKS):
            self.turn += 1
            slot = bucket * SLOTS + self.turn % SLOTS
            mark, self.cells[slot] = self.cells[slot], mark
            bucket = self._other(bucket, mark)
            slot = self._slot(bucket, 0)
            if slot >= 0:
                self.cells[slot] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for digests that were inserted."""
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            slot = self._slot(bucket, mark)
            if slot >= 0:
                self.cells[slot] = 0
                return True
        return False


class LiveIndex:
    """Live digests of a shard: the filter in front, the content in buckets behind it."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.content: dict[bytes, list[list]] = {}
        self.resizes = 0

    def _verified(self, digest: bytes, size: int) -> list | None:
        if digest not in self.filter:
            return None
        for entry in self.content.get(digest[:4], ()):
            if entry[0] == digest and entry[1] == size:
                return entry
        return None

    def _insert(self, digest: bytes) -> None:
        if not self.filter.insert(digest):
            self._resize()

    def _resize(self) -> None:
        buckets = self.filter.buckets
        while True:
            buckets *= 2
            self.resizes += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(entry[0]) for bucket in self.content.values() for entry in bucket):
                return

    def add(self, digest: bytes, size: int, doc_id: int | None, rows: int = 1) -> None:
        entry = self._verified(digest, size)
        if entry is None:
            self.content.setdefault(digest[:4], []).append([digest, size, doc_id, rows])
            self._insert(digest)
        elif doc_id is not None and (entry[2] is None or doc_id > entry[2]):
            self.remove(digest, size)
            self.content.setdefault(digest[:4], []).append([digest, size, doc_id, entry[3] + rows])
            self._insert(digest)
        else:
            entry[3] += rows

    def remove(self, digest: bytes, size: int) -> bool:
        entry = self._verified(digest, size)
        if entry is None:
            return False
        bucket = self.content[digest[:4]]
        bucket.remove(entry)
        if not bucket:
            del self.content[digest[:4]]
        self.filter.delete(digest)
        return True

    def retire(self, digest: bytes, size: int, doc_id: int | None, rows: int) -> bool:
        """Take rows of one document out of its group; whether that document was the one that stays and others are left."""
        entry = self._verified(digest, size)
        if entry is None:
            return False
        if entry[3] <= rows:
            self.remove(digest, size)
            return False
        entry[3] -= rows
        if entry[2] != doc_id:
            return False
        entry[2] = None
        return True

    def entries(self):
        for bucket in self.content.values():
            yield from bucket


_INDEX = "digest binary, size long, keep_id long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("size", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest of the normalised text, its length in bytes."""

    def task(batch):
        data, rows = utf8(batch)
        whole = data.tobytes().translate(LOWER_TABLE)
        ends = rows.tolist()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([hashlib.sha256(whole[a:b]).digest() for a, b in zip(ends, ends[1:])], pa.binary()), pa.array([b - a for a, b in zip(ends, ends[1:])], pa.int64())],
            names=["doc_id", "digest", "size"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(plain, task, "doc_id long, digest binary, size long")


def _emit(index: LiveIndex):
    entries = list(index.entries())
    for at in range(0, len(entries), 50_000):
        part = entries[at: at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in part], kind.type) for i, kind in enumerate(_ARROW)], schema=_ARROW)


def _collapse(batches):
    """One task: its rows through one index shard."""
    index = LiveIndex()
    for batch in batches:
        for digest, size, keep, rows in zip(*(c.to_pylist() for c in batch.columns)):
            index.add(digest, size, keep, rows)
    yield from _emit(index)


def build_index(rows: DataFrame) -> DataFrame:
    """Live digests with the id that stays and the size of the group; ``rows`` as of ``digests``."""
    one = rows.select("digest", "size", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.mapInArrow(_collapse, _INDEX).repartition(parts, "digest").mapInArrow(_collapse, _INDEX)


def update_index(index: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """A stored index after deletions and insertions, both given as rows of ``digests``.

    A deletion names a document: its group loses one row for each, and leaves the index and its
    filter with the last one.  If the document that stays is deleted, the next largest id of
    ``rows`` (the digests of all documents before the update) takes its place; without ``rows``
    that is an error.  Deletions apply to what the index held before; a text that is deleted and
    added again is live.  Deletions of unknown digests change nothing.
    """
    kind = F.lit(0).cast("long").alias("kind")
    changes = index.select(kind, "digest", "size", "keep_id", "group_size")
    if removed is not None:
        gone = removed.select("digest", "size", F.col("doc_id").alias("keep_id"))
        # one row a digest and id, however many rows of one id go
        changes = changes.unionByName(gone.groupBy("digest", "size", "keep_id").agg(F.count("*").alias("group_size")).select(F.lit(1).cast("long").alias("kind"), "digest", "size", "keep_id", "group_size"))
    if added is not None:
        changes = changes.unionByName(build_index(added).select(F.lit(2).cast("long").alias("kind"), "digest", "size", "keep_id", "group_size"))

    def task(batches):
        shard, lost = LiveIndex(), set()
        for batch in batches:
            for what, digest, size, keep, count in zip(*(c.to_pylist() for c in batch.columns)):
                if what != 1:
                    shard.add(digest, size, keep, count)
                elif shard.retire(digest, size, keep, count):
                    lost.add(digest)
        for part in _emit(shard):
            yield part.append_column("lost", pa.array([d in lost for d in part.column(0).to_pylist()], pa.bool_()))

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = changes.repartition(parts, "digest").sortWithinPartitions("kind").mapInArrow(task, f"{_INDEX}, lost boolean")
    if removed is None:
        return out.drop("lost")
    if rows is None:
        return out.withColumn("keep_id", F.when(F.col("lost"), F.raise_error("a document that stays was deleted: pass rows")).otherwise(F.col("keep_id"))).drop("lost")
    gone = removed.select("digest", F.col("doc_id").alias("_gone")).distinct()
    left = rows.select("digest", "doc_id").join(gone, (rows["digest"] == gone["digest"]) & rows["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
    next_id = left.groupBy("digest").agg(F.max("doc_id").alias("_next"))
    return out.join(next_id, "digest", "left").withColumn("keep_id", F.when(F.col("lost"), F.greatest("keep_id", "_next")).otherwise(F.col("keep_id"))).select("digest", "size", "keep_id", "group_size")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows that repeat id and text, all are reported as kept.  The join is on digests alone,
    so a hot group is split by the adaptive skew join.
    """
    rows = saved(digests(docs, id_col, text_col))
    index = build_index(rows).select("digest", "keep_id", "group_size")
    return rows.join(index, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of every text that stays, with all its columns; of rows equal in id and text one stays.

    Rows meet the index by digest and id together, so a hot text is spread over all tasks.
    """
    docs = docs.drop("_digest", "_held", "_keep", "_row")

    def task(batch):
        data, rows = utf8(batch, text_col)
        whole, ends = data.tobytes().translate(LOWER_TABLE), rows.tolist()
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([hashlib.sha256(whole[a:b]).digest() for a, b in zip(ends, ends[1:])], pa.binary())], names=[*batch.schema.names, "_digest"])

    marked = map_slices(docs, task, StructType([*docs.schema.fields, StructField("_digest", BinaryType())]), text_col)
    index = build_index(saved(digests(docs, id_col, text_col))).select(F.col("digest").alias("_held"), F.col("keep_id").alias("_keep"))
    first = Window.partitionBy("_digest", id_col).orderBy(F.lit(0))
    met = marked.join(index, (F.col("_digest") == F.col("_held")) & F.col(id_col).eqNullSafe(F.col("_keep")))
    return met.withColumn("_row", F.row_number().over(first)).filter("_row = 1").select(*docs.columns)


def op10_cuckoo_dedup(spark, sf_dir) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
