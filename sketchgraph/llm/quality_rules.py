"""Quality rules: counts over a text and bands of n-gram perplexity by language.

The model is a modified Kneser-Ney model of order four over the bytes of running text (words with a space after each), one
for each language. Spark counts the n-grams of all documents and deals them by language and last byte of their
context: all longer contexts that an n-gram backs off to lie in its shard. Counts of counts and the continuation counts of
single symbols are summed over a language's shards; then each shard's probabilities and back-off weights are put in arrays
sorted by hash, from which the n-grams that occur get their values once. No task and no driver holds a whole model.

A document is rejected if its perplexity leaves its language's band, which is set from the quartiles of all documents of the
language that pass the counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, map_rows, mix, write_table
from .events import SYMBOL_BITS, Summer, count_events, hot_events, rare_event_sums
from .text_stats import base_counts
from .vocab import with_row_ids

#: Order of the n-grams, and symbols: all bytes, of which the space also ends a text.
ORDER, SYMBOLS, END = 4, 256, 0x20
#: Interquartile half-ranges below and above the median of log perplexity that a language's band spans: Tukey's fences, 1.5
#: interquartile ranges beyond the quartiles, which a normal spread leaves with 0.7 % of its values.
BELOW, ABOVE = 4.0, 4.0
#: Log perplexities are binned this finely for the quartiles.
BIN = 1e-4


def _mask(order: int) -> int:
    return (1 << (8 * (order - 1) + SYMBOL_BITS)) - 1


def levels(codes: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each order from the top to two: the n-grams in order and their counts, below the top those of distinct bytes before them."""
    out = {ORDER: (codes, counts)}
    for order in range(ORDER - 1, 1, -1):
        grams, seen = np.unique(out[order + 1][0] & _mask(order), return_counts=True)
        out[order] = (grams, seen)
    return out


def tally(grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """How many n-grams have counts of 1, 2, 3 and 4: four numbers an order from the top to two."""
    return [int((grams[order][1] == k).sum()) for order in range(ORDER, 1, -1) for k in (1, 2, 3, 4)]


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, kept within their range where counts of counts are sparse."""
    n1, n2, n3, n4 = np.maximum(n, 1.0)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])


class KneserNey:
    """Interpolated modified Kneser-Ney over the n-grams of one shard, looked up in sorted hash arrays."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], counts_of_counts: list[int], single: np.ndarray):
        """``single`` has the continuation count of each symbol in the whole language, ``counts_of_counts`` its :func:`tally`."""
        d = discounts([int((single == k).sum()) for k in (1, 2, 3, 4)])
        off = d[np.minimum(single, 3)]
        total = max(single.sum(), 1)
        self.single = (single - off) / total + (off.sum() / total if single.any() else 1.0) / SYMBOLS
        keys, values = [], []
        below_grams, below = np.arange(SYMBOLS), self.single
        for order in range(2, ORDER + 1):
            found, seen = grams[order]
            at = 4 * (ORDER - order)
            off = discounts(np.array(counts_of_counts[at : at + 4], float))[np.minimum(seen, 3)]
            contexts, where = np.unique(found >> SYMBOL_BITS, return_inverse=True)
            total = np.bincount(where, seen, len(contexts))
            gamma = np.bincount(where, off, len(contexts)) / total
            p = (seen - off) / total[where] + gamma[where] * below[np.searchsorted(below_grams, found & _mask(order - 1))]
            keys += [self.hash(found, order), self.hash(contexts, order + 16)]
            values += [np.log(p), np.log(gamma)]
            below_grams, below = found, p
        every = np.concatenate(keys)
        by = np.argsort(every)
        self.keys, self.values = every[by], np.concatenate(values)[by]

    @staticmethod
    def hash(codes: np.ndarray, kind: int) -> np.ndarray:
        return mix(codes.astype(np.uint64) + np.uint64(kind << 48))

    def look(self, codes: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is there, and its value or 0."""
        h = self.hash(codes, kind)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        found = self.keys[at] == h
        return found, np.where(found, self.values[at], 0.0)

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each n-gram's symbol after the bytes before it; unseen ones back off."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, 1, -1):
            mine = codes[open_] & _mask(order)
            found, p = self.look(mine, order)
            out[open_] += np.where(found, p, self.look(mine >> SYMBOL_BITS, order + 16)[1])
            open_ = open_[~found]
        out[open_] += np.log(self.single[codes[open_] & _mask(1)])
        return out


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[pa.RecordBatch]]]:
    """(group, slices) of each run of equal (first, second) column; rows are sorted by them."""
    key, held = None, []
    for batch in it:
        if not batch.num_rows:
            continue
        grp, last = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        which = grp.indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (last[1:] != last[:-1])]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            mine = (grp.dictionary[int(which[a])].as_py(), int(last[a]))
            if mine != key:
                if held:
                    yield key[0], held
                key, held = mine, []
            held.append(batch.slice(a, b - a))
    if held:
        yield key[0], held


def _column(parts: list[pa.RecordBatch], k: int) -> np.ndarray:
    return np.concatenate([p.column(k).drop_null().to_numpy() for p in parts])


def ngram_model(counts: DataFrame) -> DataFrame:
    """(grp, code, n_all, value): the natural logarithm of the probability of every n-gram of ``counts`` (grp, code, n_all), a written table."""
    last = F.shiftright("code", SYMBOL_BITS).bitwiseAND(F.lit(255)).cast("int")
    dealt = counts.select("grp", last.alias("last"), "code", "n_all")

    def count(it):
        for grp, parts in _runs(it):
            grams = levels(_column(parts, 2), _column(parts, 3))
            yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([parts[0].column(1)[0].as_py()], pa.int32()), pa.array([tally(grams)]), pa.array([(grams[2][0] & _mask(1)).tolist()], pa.list_(pa.int64()))], names=["grp", "last", "tally", "symbols"])

    tallies = write_table(dealt.repartition("grp", "last").sortWithinPartitions("grp", "last", "code").mapInArrow(count, "grp string, last int, tally array<long>, symbols array<long>"), "tallies")
    sums = tallies.groupBy("grp").agg(F.array(*(F.sum(F.col("tally")[k]) for k in range(4 * (ORDER - 1)))).alias("tally"))
    single = tallies.select("grp", F.explode("symbols").alias("s")).groupBy("grp", "s").count().groupBy("grp").agg(F.collect_list("s").alias("s"), F.collect_list("count").alias("n"))
    whole = tallies.select("grp", "last").join(sums.join(single, "grp"), "grp").select("grp", "last", F.lit(None).cast("long").alias("code"), F.lit(None).cast("long").alias("n_all"), "tally", "s", "n")

    def values(it):
        for grp, parts in _runs(it):
            codes, n_all = _column(parts, 2), _column(parts, 3)
            of_language = parts[0].slice(0, 1).to_pylist()[0]
            single = np.zeros(SYMBOLS, np.int64)
            single[of_language["s"]] = of_language["n"]
            got = KneserNey(levels(codes, n_all), of_language["tally"], single).log_p(codes)
            for at in range(0, len(codes), 65536):
                part = slice(at, at + 65536)
                yield pa.RecordBatch.from_arrays([pa.array([grp] * len(codes[part]), pa.string()), pa.array(codes[part]), pa.array(n_all[part]), pa.array(got[part])], names=["grp", "code", "n_all", "value"])

    none = F.lit(None).cast("array<long>")
    both = whole.unionByName(dealt.select("*", none.alias("tally"), none.alias("s"), none.alias("n")))
    return both.repartition("grp", "last").sortWithinPartitions("grp", "last", F.col("code").asc_nulls_first()).mapInArrow(values, "grp string, code long, n_all long, value double")


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ppl) of every row; log_ppl is null without words."""
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")), F.col("lang"))
    counts = write_table(count_events(rows.select(F.col("lang").alias("grp"), F.lit(True).alias("counted"), "text"), ORDER - 1, bytes.split, empty=False, end=END), "ngrams")
    model = write_table(ngram_model(counts), "ngram-values")
    hot = docs.sparkSession.sparkContext.broadcast(hot_events(model))

    def make():
        hashes, add = WordHashes(), Summer(hot.value, ORDER - 1, END)

        def block(rows):
            split = [r[-1].split() for r in rows]
            groups = defaultdict(list)
            for k, r in enumerate(rows):
                if split[k]:
                    groups[r[2]].append(k)
            found = {}
            for lang, places in groups.items():
                totals, rare = add(lang, [b" ".join(split[k]) for k in places])
                found |= {k: (t, codes) for k, t, codes in zip(places, totals.tolist(), rare, strict=True)}
            for k, ((row, doc_id, lang, data), words) in enumerate(zip(rows, split, strict=True)):
                yield (row, doc_id, lang, len(words), *base_counts(data, words, hashes), sum(map(len, words)) + len(words), *found.get(k, (None, None)))

        def run(rows):
            held, size = [], 0
            for r in rows:
                held.append(r)
                size += len(r[-1])
                if len(held) >= 256 or size >= 1 << 20:
                    yield from block(held)
                    held, size = [], 0
            yield from block(held)

        return run

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("grp", pa.string()), *((n, pa.int64()) for n in names), ("symbols", pa.int64()), ("total", pa.float64()), ("rare_events", pa.binary())])
    ddl = "row long, doc_id long, grp string, " + ", ".join(f"{n} long" for n in names) + ", symbols long, total double, rare_events binary"
    summed = write_table(map_rows(rows.select("row", "doc_id", "lang", "text"), make, schema, ddl, 1024), "sums")
    whole = summed.join(rare_event_sums(summed, model, "value"), "row", "left")
    log_ppl = -(F.col("total") + F.coalesce("extra", F.lit(0.0))) / F.col("symbols")
    return whole.select("doc_id", F.col("grp").alias("lang"), *names, log_ppl.alias("log_ppl"))


def bands(rows: DataFrame) -> DataFrame:
    """(lang, low, high): each language's band of log perplexity, from exact quartiles of its values in bins of BIN."""
    bins = rows.where(~F.col("base_failed")).groupBy("lang", F.round(F.col("log_ppl") / BIN).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    table: dict[str, list] = defaultdict(list)
    for r in bins.collect():
        table[r["lang"]].append((r["bin"], r["n"]))
    out = []
    for lang, found in sorted(table.items()):
        at, n = np.array(sorted(found)).T
        q1, q2, q3 = (at[np.searchsorted(np.cumsum(n), n.sum() * q)] * BIN for q in (0.25, 0.5, 0.75))
        out.append((lang, float(q2 - BELOW * max(q2 - q1, 0.01)), float(q2 + ABOVE * max(q3 - q2, 0.01))))
    return rows.sparkSession.createDataFrame(out, "lang string, low double, high double")


def quality_rules(docs: DataFrame) -> DataFrame:
    """The rules' counts and verdict for every row of ``docs`` (doc_id long, text, lang).

    base_failed: fewer than 50 words, or over half of the words in repeated windows of three. kept: not base_failed and log
    perplexity within the language's band. Null texts have no words and fail; a null lang is a language of its own; repeated
    rows give a row each; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    rows = scored(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = write_table(rows.withColumn("base_failed", failed), "rules")
    limits = bands(rows)
    if limits.count() <= 10_000:
        limits = F.broadcast(limits)
    within = F.col("log_ppl").between(F.col("low"), F.col("high"))
    return rows.join(limits, "lang", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(~F.col("base_failed") & within, F.lit(False)).alias("kept"), F.exp("log_ppl").alias("perplexity"))
