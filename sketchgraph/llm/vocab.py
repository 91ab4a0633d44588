"""Values of distinct units (words, pre-tokens) summed over documents, without a skewed or unbounded join.

1. ``count_units`` gives every distinct unit once, pre-aggregated in each task.
2. ``hot_units`` reads the most frequent units, at most ``HOT_UNITS`` of at most ``HOT_BYTES`` bytes each, to the driver:
   a table of bounded size, whatever the corpus.
3. ``document_units`` sums the hot units' values in the scan and keeps each document's other units with their
   frequencies; ``rare_sums`` joins those to the full table. No unit of the join is frequent, so none is skewed.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_words, map_rows, rows_of, small_batches, text_bytes, write_table

#: Bounds of the broadcast table of frequent units.
HOT_UNITS, HOT_BYTES = 250_000, 48
#: Distinct words that a task counts before it passes its counts on, or knows before it begins anew; bytes of a block of texts.
HELD_WORDS, BLOCK_BYTES = 300_000, 1 << 19


class Split(Protocol):
    """How texts fall into words, and those into units; ``whole`` says that each word is one unit."""

    whole: bool

    def words(self, data: bytes) -> list[bytes]: ...

    def units(self, word: bytes) -> tuple[bytes, ...]: ...


class LowerWords:
    """Lower-cased words, each a unit."""

    whole = True

    def words(self, data: bytes) -> list[bytes]:
        return lower_words(data)

    def units(self, word: bytes) -> tuple[bytes, ...]:
        return (word,)


def with_row_ids(docs: DataFrame, *more: Column) -> DataFrame:
    """(row, doc_id, text as bytes, ...): ``row`` tells rows apart whose doc_id is null or repeated."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text_bytes().alias("text"), *more)


def count_units(docs: DataFrame, split: Callable[[], Split], counted: Column | None = None) -> DataFrame:
    """(unit binary, n_all, n): how often each distinct unit occurs in all rows, and in those where ``counted`` holds."""

    def run(it):
        of = split()
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            for words, is_counted in zip(seen, (False, True), strict=True):
                units = words
                if not of.whole:
                    units = Counter()
                    for word, n in words.items():
                        for u in of.units(word):
                            units[u] += n
                found, times = list(units), list(units.values())
                for at in range(0, len(found), 65536):
                    part, n = pa.array(found[at : at + 65536], pa.binary()), pa.array(times[at : at + 65536], pa.int64())
                    yield pa.RecordBatch.from_arrays([part, n, n if is_counted else pa.array(np.zeros(len(n), np.int64))], names=["unit", "n_all", "n"])
                words.clear()

        for batch in it:
            for data, kept in rows_of(batch):
                seen[bool(kept)].update(of.words(data))
                if len(seen[0]) + len(seen[1]) >= HELD_WORDS:
                    yield from out()
        yield from out()

    rows = docs.select(text_bytes().alias("text"), (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).alias("counted"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, "unit binary, n_all long, n long").groupBy("unit").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"))


def hot_units(table: DataFrame) -> list[tuple]:
    """The rows of the most frequent units, as many as the bounds allow; the bar is set from a histogram of frequencies."""
    able = table.where(F.octet_length("unit") <= HOT_BYTES)
    step = F.floor(16 * F.log2(F.col("n_all").cast("double")))
    bar, total = 1 << 62, 0
    for low, rows in sorted(((r["step"], r["count"]) for r in able.groupBy(step.alias("step")).count().collect()), reverse=True):
        total += rows
        if total > HOT_UNITS:
            break
        bar = low
    got = able.where(step >= F.lit(bar)).toArrow()
    return list(zip(*(c.to_pylist() for c in got.columns), strict=True)) if got.num_rows else []


class _Numbers(dict):
    """Numbers words as they come, with each word's number of units, sums of known units' values, and other units."""

    def __init__(self, of: Split, known: dict[bytes, tuple], n_values: int):
        self.of, self.known, self.zeros = of, known, (0,) * n_values
        self.sums, self.others = array("d"), {}

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        units, known = self.of.units(word), self.known
        self.sums.append(len(units))
        if len(units) == 1:
            values = known.get(units[0])
            self.sums.extend(self.zeros if values is None else values)
            if values is None:
                self.others[number] = units
            return number
        found = [known[u] for u in units if u in known]
        self.sums.extend(map(sum, zip(*found, strict=True)) if found else self.zeros)
        if len(found) < len(units):
            self.others[number] = [u for u in units if u not in known]
        return number


class UnitSums:
    """For texts as lists of words: how many units each has, the sums of its known units' values, and its other units with their frequencies."""

    def __init__(self, of: Split, known: dict[bytes, tuple], n_values: int):
        self.n_values, self.fresh = n_values, lambda: _Numbers(of, known, n_values)
        self.numbers = self.fresh()
        if of.whole:  # words are units: only known ones need numbers, and the last row stands for all others
            self.numbers = {u: i for i, u in enumerate(known)}
            self.table = np.array([(1, *v) for v in known.values()] + [(1, *[0] * n_values)], float)
        self.whole = of.whole

    def __call__(self, texts: list[list[bytes]]) -> tuple[list[int], list[list[float]], list[list[dict]]]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), sizes)
        rare: list[Counter] = [Counter() for _ in texts]
        if self.whole:
            words = list(chain.from_iterable(texts))
            which, table = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words)), self.table
            at = np.flatnonzero(which < 0)
            for text, k in zip(owner[at].tolist(), at.tolist(), strict=True):
                rare[text][words[k]] += 1
        else:
            if len(self.numbers) >= HELD_WORDS:  # bounds the worker's memory
                self.numbers = self.fresh()
            which = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
            table, others = np.array(self.numbers.sums).reshape(-1, 1 + self.n_values), self.numbers.others
            partly = np.zeros(len(table), bool)
            partly[list(others)] = True
            at = np.flatnonzero(partly[which])
            for text, number in zip(owner[at].tolist(), which[at].tolist(), strict=True):
                for u in others[number]:
                    rare[text][u] += 1
        sums = [np.bincount(owner, table[which, k], len(texts)) for k in range(1 + self.n_values)]
        return sums[0].astype(np.int64).tolist(), [s.tolist() for s in sums[1:]], [[{"unit": u, "f": f} for u, f in r.items()] for r in rare]


RARE, RARE_DDL = pa.list_(pa.struct([("unit", pa.binary()), ("f", pa.int64())])), "rare array<struct<unit:binary,f:bigint>>"


def _blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """(row, doc_id, text) tuples, about BLOCK_BYTES of text at a time."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= BLOCK_BYTES or len(held) >= 1024:
            yield held
            held, size = [], 0
    if held:
        yield held


def document_units(rows: DataFrame, split: Callable[[], Split], hot: dict[bytes, tuple], n_values: int, name: str) -> DataFrame:
    """A written table (row, doc_id, n_bytes, n_units, v0.., rare) from (row, doc_id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def make():
        of = split()
        add = UnitSums(of, shared.value, n_values)

        def run(it):
            for block in _blocks(it):
                n, sums, rare = add([of.words(r[2]) for r in block])
                for k, (row, doc_id, data) in enumerate(block):
                    yield (row, doc_id, len(data), n[k], *(s[k] for s in sums), rare[k])

        return run

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_units", pa.int64()), *((f"v{k}", pa.float64()) for k in range(n_values)), ("rare", RARE)])
    ddl = ", ".join(["row long, doc_id long, n_bytes long, n_units long", *(f"v{k} double" for k in range(n_values)), RARE_DDL])
    return write_table(map_rows(rows.select("row", "doc_id", "text"), make, schema, ddl, 512), name)


def rare_sums(units: DataFrame, table: DataFrame, values: list[Column]) -> DataFrame:
    """``units`` with v0.. completed by the rare units' values, looked up in ``table``."""
    n = len(values)
    long = units.where(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", "r.unit", "r.f")
    looked = long.join(table.select("unit", *(v.cast("double").alias(f"w{k}") for k, v in enumerate(values))), "unit")
    sums = looked.groupBy("row").agg(*(F.sum(F.col(f"w{k}") * F.col("f")).alias(f"w{k}") for k in range(n)))
    whole = units.drop("rare").join(sums, "row", "left")
    return whole.withColumns({f"v{k}": F.col(f"v{k}") + F.coalesce(f"w{k}", F.lit(0.0)) for k in range(n)}).drop(*(f"w{k}" for k in range(n)))
