"""Language-model scores by prediction by partial matching (PPM) over the bytes of documents.

A document is its lower-cased words with a space between them. A byte-context trie of order five counts, in the training
documents, which byte (or end) follows each context; contexts run across words and begin with the document. A symbol is
coded at the longest known context: by its count there less a half, or by an escape (method D: half a count for each
distinct symbol) to the next shorter one, where the symbols already ruled out are excluded.

The trie is never in one place. Events of all documents are counted by Spark and dealt by the last two bytes of their
context: the part of the trie below such a context lies in one task, which works out the code length of each of its
events. Contexts of one byte and none (``LOW_ROWS`` edges at most) go to all tasks. Documents then add up the code lengths
of their events, see :mod:`.events`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_words, small_batches, write_table
from .events import SYMBOL_BITS, Summer, count_events, hot_events, rare_event_sums, text_blocks
from .vocab import RARE, RARE_DDL, LowerWords, UnitSums, count_units, hot_units, rare_sums, with_row_ids

ORDER, SYMBOLS = 5, 257
#: Bytes of context by which events are dealt, and the most edges that shorter contexts have.
DEALT, LOW_ROWS = 2, (1 + 256) * SYMBOLS
#: Events that a task works on at once (more only where one context of two bytes has more), and events a partition.
TOGETHER, PART_EVENTS = 250_000, 4_000_000


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 7, is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _mask(k: int) -> int:
    return (1 << (8 * k + SYMBOL_BITS)) - 1


def _level(edge: np.ndarray, n: np.ndarray, below: tuple | None, k: int) -> tuple:
    """(edges, counts, contexts, totals, distinct symbols, what escapes exclude below) of the contexts of ``k`` bytes."""
    context, where = np.unique(edge >> SYMBOL_BITS, return_inverse=True)
    total, distinct = np.bincount(where, n, len(context)), np.bincount(where, minlength=len(context)).astype(float)
    excluded = np.zeros(len(context))
    if below is not None and len(edge):
        excluded = np.bincount(where, below[1][np.searchsorted(below[0], edge & _mask(k - 1))], len(context))
    return edge, n.astype(float), context, total, distinct, excluded


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge, where = np.unique(keys, return_inverse=True)
    return edge, np.bincount(where, n, len(edge))


def low_levels(edge: np.ndarray, n: np.ndarray) -> list[tuple]:
    """The levels of no and one byte of context, from the counts of (byte, symbol)."""
    none = _level(*_summed(edge & _mask(0), n), None, 0)
    one, m = _summed(edge, n)
    return [none, _level(one, m, none, 1)]


class Trie:
    """The contexts below some contexts of two bytes, and all shorter ones, with what PPM needs of each."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, low: list[tuple]):
        """``codes`` and ``counts`` of training events; shorter contexts count what all longer ones hold."""
        self.levels = list(low)
        for k in range(DEALT, ORDER + 1):
            self.levels.append(_level(*_summed(codes & _mask(k), counts), self.levels[-1], k))

    def log10_p(self, codes: np.ndarray) -> np.ndarray:
        """Base-10 logarithm of each event's probability."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        off_total, off_distinct = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(ORDER, -1, -1):
            edge, n, context, total, distinct, excluded = self.levels[k]
            if not len(edge) or not len(open_):
                continue
            key = codes[open_] & _mask(k)
            c = np.minimum(np.searchsorted(context, key >> SYMBOL_BITS), len(context) - 1)
            e = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
            known, seen = context[c] == key >> SYMBOL_BITS, edge[e] == key
            left, fresh = total[c] - off_total[open_], distinct[c] - off_distinct[open_]
            coded = known & (left > 0)
            p = np.where(seen, n[e] - 0.5, fresh / 2) / np.where(coded, left, 1.0)
            out[open_[coded]] += np.log10(p[coded])
            off_total[open_[known]], off_distinct[open_[known]] = excluded[c[known]], distinct[c[known]]
            open_ = open_[~seen]
        out[open_] -= np.log10(np.maximum(SYMBOLS - off_distinct[open_], 1.0))
        return out


def event_model(events: DataFrame) -> DataFrame:
    """(grp, code, n_all, value): the base-10 logarithm of the probability of every event of ``events`` (grp, code, n_all, n)."""
    low_key = F.col("code").bitwiseAND(F.lit(_mask(1)))
    got = events.where("n > 0").groupBy(low_key.alias("edge")).agg(F.sum("n").alias("n")).toArrow()
    low = events.sparkSession.sparkContext.broadcast(low_levels(got.column("edge").to_numpy(), got.column("n").to_numpy()))

    def values(codes, n_all, n):
        codes, n_all, n = (np.concatenate(x) for x in (codes, n_all, n))
        got = Trie(codes[n > 0], n[n > 0], low.value).log10_p(codes)
        for at in range(0, len(codes), 65536):
            part = slice(at, at + 65536)
            yield pa.RecordBatch.from_arrays([pa.array([""] * len(codes[part]), pa.string()), pa.array(codes[part]), pa.array(n_all[part]), pa.array(got[part])], names=["grp", "code", "n_all", "value"])

    def run(it):
        held, size = ([], [], []), 0
        for batch in it:
            if not batch.num_rows:
                continue
            shard, *columns = (c.to_numpy() for c in batch.columns)
            if size >= TOGETHER:  # all that is held before the batch's last change of shard can go
                border = np.flatnonzero(np.concatenate([[shard[0] != last], shard[1:] != shard[:-1]]))
                if len(border):
                    yield from values(*([*h, c[: border[0]]] for h, c in zip(held, columns, strict=True)))
                    held, size, columns = ([], [], []), 0, [c[border[0] :] for c in columns]
            for h, c in zip(held, columns, strict=True):
                h.append(c)
            last, size = shard[-1], size + len(columns[0])
        if size:
            yield from values(*held)

    parts = max(1, -(-events.count() // PART_EVENTS), int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = F.shiftright("code", SYMBOL_BITS).bitwiseAND(F.lit((1 << 8 * DEALT) - 1))
    dealt = events.select(shard.cast("int").alias("shard"), "code", "n_all", "n").repartition(parts, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "grp string, code long, n_all long, value double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id long, text).

    Tokens are the lower-cased words and one end. base_score is the add-one unigram log10 probability, score that of the
    PPM model; both learn from the rows that are not held out. Null texts count as empty and have the end alone; repeated
    rows give a row each and are all learned from; texts of any length are coded whole, in slices; other columns are
    ignored; an empty table gives no rows. With no training rows the model is uniform.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    small_batches(spark)
    rows = with_row_ids(docs, held_out().alias("held_out"))
    found = write_table(count_units(docs, LowerWords, ~held_out()), "words")
    train = found.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = docs.where(~held_out()).count()
    n_train, n_types = train[0] + n_texts, train[1] + (n_texts > 0)
    counted = rows.select(F.lit("").alias("grp"), (~F.col("held_out")).alias("counted"), "text")
    events = write_table(count_events(counted, ORDER, lower_words, empty=True), "events")
    model = write_table(event_model(events), "event-values")

    def base(n):
        return float(np.log10((n + 1) / (n_train + n_types + 1)))

    values: dict[int, tuple] = {}  # words of one frequency share theirs
    hot = spark.sparkContext.broadcast((hot_events(model), {u: values.setdefault(n, (base(n), float(n > 0))) for u, _, n in hot_units(found)}))

    def code(it):
        event_sums, of = Summer(hot.value[0], ORDER), LowerWords()
        unit_sums = UnitSums(of, hot.value[1], 2)
        for part, texts in text_blocks(it, 2, lower_words):
            totals, events_left = event_sums("", texts)
            n, (v0, v1), units_left = unit_sums([t.split() for t in texts])
            columns = [part.column(0), part.column(1), part.column(3), pa.array(totals), pa.array(events_left, pa.binary()), pa.array(n), pa.array(v0), pa.array(v1), pa.array(units_left, RARE)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "score", "rare_events", "n_units", "v0", "v1", "rare"])

    units = write_table(rows.mapInArrow(code, f"row long, doc_id long, held_out boolean, score double, rare_events binary, n_units long, v0 double, v1 double, {RARE_DDL}"), "word-docs")
    extra = rare_event_sums(units.select("row", F.lit("").alias("grp"), "rare_events"), model, "value")
    rows = rare_sums(units, found, [F.log10((F.col("n") + 1) / F.lit(float(n_train + n_types + 1))), (F.col("n") > 0).cast("double")]).join(extra, "row", "left")
    return rows.select(
        "doc_id", "held_out", (F.col("n_units") + 1).alias("n_tokens"), (F.col("v1").cast("long") + int(n_texts > 0)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("v0") + base(n_texts)).alias("base_score"), (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"),
    )
