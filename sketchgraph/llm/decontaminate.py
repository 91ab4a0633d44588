"""Benchmark decontamination by Wu-Manber search for windows of words.

Test items are cut into windows of ten consecutive words (shorter items are one window). Windows of one length form a
machine: a shift table over blocks of words skips positions where no window can end, buckets by the last block pick the
windows to compare, and a direct comparison confirms. Items are searched in blocks of bounded size, one after another, each
over all documents: a benchmark of up to ``BLOCK_BYTES`` takes one scan.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, text_bytes, write_table
from .vocab import with_row_ids

#: Words in a window; bytes of item texts that one broadcast block holds at most (unless one item alone is longer).
WINDOW, BLOCK_BYTES = 10, 16 << 20
#: A-Z become a-z; other ASCII characters but digits and letters become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return data.translate(FOLD).split()


class WuManber:
    """Windows of ``m`` words each: ``find`` yields the start of every occurrence with the window's number."""

    def __init__(self, windows: dict[tuple[bytes, ...], int]):
        self.m = len(next(iter(windows)))
        self.block = min(3, self.m)
        self.words = {w for window in windows for w in window}
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list] = defaultdict(list)
        for window, number in windows.items():
            for end in range(self.block, self.m + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.m), self.m - end)
            self.buckets[window[self.m - self.block :]].append((window, number))

    def find(self, words: list[bytes]):
        m, b, known, shift, far = self.m, self.block, self.words, self.shift, self.m - self.block + 1
        at, n = m - 1, len(words)
        while at < n:
            if words[at] not in known:  # no window holds this word, so none covers this place
                at += m
                continue
            block = tuple(words[at - b + 1 : at + 1])
            step = shift.get(block, far)
            if step:
                at += step
                continue
            here = tuple(words[at - m + 1 : at + 1])
            for window, number in self.buckets[block]:
                if window == here:
                    yield at - m + 1, number
            at += 1


def item_windows(data: bytes, n: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = words_of(data)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _machines(items: list[tuple[str | None, bytes]], n: int):
    """The machines of one block of items, and the item ids of each window's number."""
    numbers: dict[tuple, int] = {}
    owners: list[set[str]] = []
    for item, data in items:
        for w in item_windows(data, n):
            k = numbers.setdefault(w, len(numbers))
            if k == len(owners):
                owners.append(set())
            if item is not None:
                owners[k].add(item)
    by_length: dict[int, dict] = defaultdict(dict)
    for w, k in numbers.items():
        by_length[len(w)][w] = k
    return [WuManber(w) for w in by_length.values()], owners


def _hits(words: list[bytes], machines, owners) -> tuple[list[tuple[int, int]], set[str]]:
    """Covered word ranges, joined and in order, and the ids of items with an occurring window."""
    found, items = [], set()
    for machine in machines:
        for at, k in machine.find(words):
            found.append((at, at + machine.m))
            items |= owners[k]
    return joined_ranges(found), items


def joined_ranges(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _item_blocks(benchmark: DataFrame, block_bytes: int):
    """Broadcast lists of (item id, text), each of about ``block_bytes`` at most; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        yield k, n_blocks, items.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in block.collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, n_words, hits array<struct<start, end>>, items array<string>) of every row of ``docs``.

    ``docs`` has (doc_id, text), ``benchmark`` (item_id, text). Null and empty texts have no words; items without words are
    never found; those without an id hit like others but are named in no list; repeated item ids count once. An empty
    benchmark hits nothing, an empty ``docs`` gives no rows; repeated documents give a row each; texts are read whole,
    whatever their length; other columns of both tables are ignored. Hits are word ranges, end exclusive.
    """
    rows = with_row_ids(docs)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
    ddl = "row long, doc_id long, n_words long, hits array<struct<start:bigint,end:bigint>>, items array<string>"
    parts = []
    for k, n_blocks, shared in _item_blocks(benchmark, block_bytes):
        if n_blocks > 1 and not k:
            rows = write_table(rows, "documents")

        def make(shared=shared, every=not k):
            machines, owners = _machines(shared.value, window)

            def run(it):
                for row, doc_id, data in it:
                    words = words_of(data)
                    hits, ids = _hits(words, machines, owners)
                    if every or hits:
                        yield row, doc_id, len(words), [{"start": a, "end": b} for a, b in hits], sorted(ids)

            return run

        found = map_rows(rows.select("row", F.col("doc_id").cast("long"), "text"), make, schema, ddl, 1024)
        if n_blocks == 1:
            return found
        parts.append(write_table(found, "hits"))  # the first has all rows, the others those with hits
        shared.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select("row", "doc_id", "n_words", _joined("hits").alias("hits"), "items")


def _joined(hits: str):
    """Sorted ranges with those that overlap or touch made one."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def add(out, h):
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= h["start"]), longer).otherwise(F.concat(out, F.array(h)))

    return F.aggregate(hits, empty, lambda out, h: F.when(F.size(out) == 0, F.array(h)).otherwise(add(out, h)))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), see :func:`contamination`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    found = contamination(docs, benchmark).withColumn("n_hit", n_hit)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of any item, see :func:`contamination`."""
    small_batches(docs.sparkSession)
    for k, n_blocks, shared in _item_blocks(benchmark, block_bytes):
        docs = docs.where(~_hit_column(shared, window))
        if n_blocks > 1 and k < n_blocks - 1:
            docs = write_table(docs, "clean")
            shared.destroy()
    return docs


def _hit_column(shared, window: int):
    @F.pandas_udf("boolean")
    def hit(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machines, _ = _machines(shared.value, window)
        for series in texts:
            yield pd.Series([any(True for m in machines for _ in m.find(words)) for words in map(words_of, series)], dtype=bool)

    return hit(text_bytes())
