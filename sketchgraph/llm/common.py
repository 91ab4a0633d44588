"""Helpers shared by the training-data operators.

Texts reach Python workers as UTF-8 bytes through Arrow: ``bytes.lower`` and ``bytes.split`` change and split exactly
the ASCII letters and white space (0x20, 0x09-0x0D) that the operators name, and need no decoding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchgraph.storage import write_table  # noqa: F401

#: Entries that a worker-local memo may hold (bounds worker memory, never changes a result).
MEMO_ENTRIES = 200_000
#: Rows of an Arrow batch: a batch's texts lie in memory at once, in the JVM and in the worker.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(column: str = "text") -> Column:
    """The column's UTF-8 bytes; null gives none."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def lower_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return data.lower().split()


def code_points(data: bytes) -> int:
    a = np.frombuffer(data, np.uint8)
    return len(data) - int(np.count_nonzero((a & 0xC0) == 0x80))


class Memo(dict):
    """A dictionary that computes missing entries and keeps the first ``entries`` of them: frequent keys come early."""

    def __init__(self, f: Callable, entries: int = MEMO_ENTRIES):
        self.f, self.entries = f, entries

    def __missing__(self, key):
        value = self.f(key)
        if len(self) < self.entries:
            self[key] = value
        return value


class WordHashes:
    """64-bit hashes of byte strings as an array, memoised by string."""

    def __init__(self):
        self.memo = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


class Table:
    """A map from distinct non-negative integers to floats, looked up by arrays of keys (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (3 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            here = self.keys[at] == keys[left]
            self.values[at[here]] = values[left[here]]
            left, at = left[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' values, and the places in ``keys`` of those that are not in the table."""
        at = self._place(keys)
        found = self.keys[at]
        out = self.values[at]
        open_ = np.flatnonzero(found != keys)
        gone = [open_[found[open_] < 0]]
        open_ = open_[found[open_] >= 0]
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at]
            out[open_] = self.values[at]
            gone.append(open_[found < 0])
            more = (found >= 0) & (found != keys[open_])
            open_, at = open_[more], at[more]
        return out, np.concatenate(gone)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each window of ``n`` hashed words, in order."""
    m = len(words) - n + 1
    h = np.full(m, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(n):
        h = mix((h + words[k : k + m]) * np.uint64(0xD6E8FEB86659FD93))
    return h


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of an Arrow batch as tuples, converted a few at a time so that long texts are not all held twice."""
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of ``size``."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[Iterator[tuple]], Iterable[tuple]]], schema: pa.Schema, ddl: str, size: int = 4096) -> DataFrame:
    """``mapInArrow`` over tuples: ``make()`` runs once a task and gives a function from its rows to output rows."""

    small_batches(df.sparkSession)

    def run(it):
        yield from batches(make()(row for b in it for row in rows_of(b)), schema, size)

    return df.mapInArrow(run, ddl)


def groups_of(rows: Iterator[tuple], n_key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``n_key`` values, from rows sorted by them."""
    key, held = None, []
    for row in rows:
        if row[:n_key] != key:
            if held:
                yield key, held
            key, held = row[:n_key], []
        held.append(row)
    if held:
        yield key, held
