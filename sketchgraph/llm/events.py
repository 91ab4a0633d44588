"""Events (a byte after the bytes before it) counted over a corpus, and their values summed over documents.

A model over events is a table with one row an event, worked out shard by shard; no task and no driver holds all of it.

1. ``count_events`` gives every distinct event of a corpus once, pre-aggregated in each task.
2. ``hot_events`` reads the most frequent ones with their values, ``HOT_EVENTS`` at most, into arrays that are broadcast: a
   table of bounded size, whatever the corpus.
3. ``summed_events`` adds the hot events' values up in the scan and keeps each document's other events, whose values
   ``rare_event_sums`` joins from the table. No event of that join is frequent, so none is skewed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, small_batches

#: Events of the broadcast table at most (12 bytes each, three slots an event).
HOT_EVENTS = 500_000
#: Bytes whose events are held as arrays at once, and distinct events that a task holds before it passes them on.
SLICE, HELD = 1 << 19, 1_000_000
#: Bits of a symbol in a code; a text's end is the symbol after all bytes, where a model does not name another.
SYMBOL_BITS, END = 9, 256


class Running:
    """The events of texts, each byte and the end of each text after the ``order`` bytes before it.

    A code is context << 9 | symbol, the latest byte of the context lowest. Texts begin after ``order`` spaces. Codes come in
    slices of positions; the positions of padding between texts hold -1.
    """

    def __init__(self, texts: list[bytes], order: int, end: int = END):
        pad, self.end = b" " * order, end
        self.order, self.data = order, np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + order) - order
        self.starts = self.ends - lengths
        self.padding = (self.ends[:, None] + np.arange(1, order)).ravel()

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first position, codes)."""
        n = len(self.data) - self.order if len(self.starts) else 0
        for at in range(0, n, SLICE):
            part = self.data[at : at + SLICE + self.order].astype(np.int64)
            m = len(part) - self.order
            codes = part[self.order - 1 :][:m].copy()
            for k in range(1, self.order):
                codes |= part[self.order - 1 - k :][:m] << (8 * k)
            codes <<= SYMBOL_BITS
            codes |= part[self.order :]
            here = _within(self.ends, at, m)
            codes[here] = (codes[here] >> SYMBOL_BITS) << SYMBOL_BITS | self.end
            codes[_within(self.padding, at, m)] = -1
            yield at, codes

    def owners(self, positions: np.ndarray) -> np.ndarray:
        """The text of each position."""
        return np.searchsorted(self.starts, positions, "right") - 1

    def add(self, totals: np.ndarray, at: int, values: np.ndarray) -> None:
        """Add the values of a slice to their texts' totals."""
        first, last = self.owners(np.array([at]))[0], np.searchsorted(self.starts, at + len(values))
        totals[first:last] += np.add.reduceat(values, np.maximum(self.starts[first:last] - at, 0), dtype=np.float64)


def _within(places: np.ndarray, at: int, m: int) -> np.ndarray:
    a, b = np.searchsorted(places, (at, at + m))
    return places[a:b] - at


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct codes in order with the sums of their counts, from parts (codes, counts, ...)."""
    codes = np.concatenate([p[0] for p in parts])
    if not len(codes):
        return parts[0]
    by = np.argsort(codes, kind="stable")
    codes = codes[by]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], *(np.add.reduceat(np.concatenate([p[k] for p in parts])[by], first) for k in range(1, len(parts[0])))


def text_blocks(it: Iterator[pa.RecordBatch], column: int, words: Callable[[bytes], list[bytes]]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(batch, its texts as words with one space between) from Arrow batches, about SLICE bytes at a time."""
    for batch in it:
        held, size, start = [], 0, 0
        for at in range(0, batch.num_rows, 64):
            part = [b" ".join(words(t)) for t in batch.column(column).slice(at, 64).to_pylist()]
            held += part
            size += sum(map(len, part))
            if size >= SLICE:
                yield batch.slice(start, len(held)), held
                start, held, size = start + len(held), [], 0
        if held:
            yield batch.slice(start, len(held)), held


def count_events(rows: DataFrame, order: int, words: Callable[[bytes], list[bytes]], empty: bool, end: int = END) -> DataFrame:
    """(grp, code, n_all, n) of all events of ``rows`` (grp string, counted boolean, text binary); n is of counted rows.

    With ``empty`` a text without words has the event of its end, otherwise none.
    """

    def run(it):
        held: dict[str, list] = defaultdict(list)
        size = 0

        def out():
            for grp, parts in held.items():
                codes, n_all, n = merged(parts)
                for at in range(0, len(codes), 65536):
                    part = slice(at, at + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * len(codes[part]), pa.string()), pa.array(codes[part]), pa.array(n_all[part]), pa.array(n[part])], names=["grp", "code", "n_all", "n"])
            held.clear()

        for batch, texts in text_blocks(it, 2, words):
            dealt = defaultdict(list)
            for grp, counted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if text or empty:
                    dealt[grp, counted].append(text)
            for (grp, counted), mine in dealt.items():
                for _, codes in Running(mine, order, end).slices():
                    found, n = np.unique(codes, return_counts=True)
                    kept = slice(int(found[0] < 0), None)
                    held[grp].append((found[kept], n[kept], n[kept] if counted else np.zeros(len(found[kept]), np.int64)))
                    size += len(found)
            if size >= HELD:
                for grp, parts in held.items():
                    held[grp] = [merged(parts)]
                size = sum(len(p[0][0]) for p in held.values())
                if size >= HELD // 2:
                    yield from out()
                    size = 0
        yield from out()

    small_batches(rows.sparkSession)
    return rows.select("grp", "counted", "text").mapInArrow(run, "grp string, code long, n_all long, n long").groupBy("grp", "code").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"))


def hot_events(model: DataFrame, most: int | None = None) -> dict[str, Table]:
    """The values of the most frequent events of ``model`` (grp, code, n_all, value), by group; the bar is set from a histogram."""
    most = HOT_EVENTS if most is None else most
    step = F.floor(16 * F.log2(F.col("n_all").cast("double")))
    bar, total = 1 << 62, 0
    for low, rows in sorted(((r["step"], r["count"]) for r in model.groupBy(step.alias("step")).count().collect()), reverse=True):
        total += rows
        if total > most:
            break
        bar = low
    got = model.where(step >= F.lit(bar)).select("grp", "code", "value").toArrow()
    groups = got.column("grp").combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
    which, codes, values = (groups.indices.to_numpy(), got.column("code").to_numpy(), got.column("value").to_numpy()) if got.num_rows else (np.empty(0, int),) * 3
    return {grp: Table(codes[which == k], values[which == k]) for k, grp in enumerate(groups.dictionary.to_pylist())}


class Summer:
    """Totals of hot values over texts, and the other events of each text."""

    def __init__(self, hot: dict[str, Table], order: int, end: int = END):
        self.hot, self.order, self.end = hot, order, end
        self.none = Table(np.empty(0, np.int64), np.empty(0))

    def __call__(self, grp: str, texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        running, table = Running(texts, self.order, self.end), self.hot.get(grp, self.none)
        totals = np.zeros(len(texts))
        codes_of, owner_of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, codes in running.slices():
            values, new = table.look(codes)
            new = np.sort(new[codes[new] >= 0])
            values[new] = 0
            running.add(totals, at, values)
            codes_of.append(codes[new])
            owner_of.append(running.owners(at + new))
        codes, owner = np.concatenate(codes_of), np.concatenate(owner_of)
        border = np.searchsorted(owner, np.arange(len(texts) + 1))
        return totals, [codes[a:b].tobytes() for a, b in zip(border[:-1], border[1:], strict=True)]


def rare_event_sums(rows: DataFrame, model: DataFrame, value: str, rare: str = "rare_events") -> DataFrame:
    """(row, extra): the values of each row's events kept in ``rare`` (binary of codes), looked up in ``model`` (grp, code, value)."""

    def run(it):
        for batch in it:
            ids, groups = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, 1024):
                codes = [np.frombuffer(b, np.int64) for b in batch.column(2).slice(at, 1024).to_pylist()]
                sizes = np.fromiter(map(len, codes), np.int64, len(codes))
                every = np.concatenate(codes)
                row = np.repeat(ids[at : at + 1024], sizes)
                grp = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(codes)), sizes).astype(np.int32)), pa.array(groups[at : at + 1024], pa.string())).cast(pa.string())
                for k in range(0, len(every), 65536):
                    part = slice(k, k + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(row[part]), grp[part], pa.array(every[part])], names=["row", "grp", "code"])

    long = rows.where(F.octet_length(rare) > 0).select("row", "grp", rare).mapInArrow(run, "row long, grp string, code long")
    return long.join(model.select("grp", "code", F.col(value).alias("w")), ["grp", "code"]).groupBy("row").agg(F.sum("w").alias("extra"))

