"""Helpers shared by the operators: tables, shared scratch tables, Arrow batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a task turns into arrays at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte table that lower-cases A-Z only.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = np.frombuffer(LOWER_TABLE, np.uint8)
_BYTE_VALUES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may lack that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="stockloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/stockloom-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read again, so that lost executors cost no recomputation."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def train_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Row slices of about ``SLICE_BYTES`` of text, so that memory does not follow the batch size."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)[column.offset: column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, text: str = "text") -> DataFrame:
    """``function`` on every slice, in Arrow; rows are neither shuffled nor gathered."""

    def task(batches):
        for part in slices(batches, text):
            out = function(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(task, schema)


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Texts of a batch as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def utf8(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null rows are empty."""
    column = batch.column(batch.schema.get_field_index(text)).fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]]
    return data, ends - ends[0]


def runs(member: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that do not cross a row."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(member), bool)
    before[0] = False
    before[1:] = member[:-1]
    edges = rows[rows < len(member)]
    before[edges] = False
    starts = np.flatnonzero(member & ~before)
    after = np.empty(len(member), bool)
    after[-1] = False
    after[:-1] = member[1:]
    after[edges[edges > 0] - 1] = False
    return starts, np.flatnonzero(member & ~after) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for i, step in enumerate((_STEP, _STEP_INVERSE)):
            values = np.full(n + 1, step, np.uint64)
            values[0] = 1
            _powers[i] = np.cumprod(values, dtype=np.uint64)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte values, from prefix sums, then mixed."""
    up, down = _grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def word_table(separators: bytes | None = None, pattern: Callable[[int], bool] | None = None) -> np.ndarray:
    """Which bytes belong to words."""
    return np.array([pattern(b) if pattern else b not in separators for b in range(256)])


def hashed_words(data: np.ndarray, rows: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row after lower-casing A-Z: their hashes, byte starts, and each row's first word (one more than rows)."""
    low = _LOWER[data]
    starts, ends = runs(member[low], rows)
    return span_hashes(low, starts, ends), starts, np.searchsorted(starts, rows)
