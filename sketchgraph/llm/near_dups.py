"""Near-duplicate documents by b-bit MinHash.

A document's set is hashed to 160 minima. 32 bands of five minima give candidates (a pair with similarity 0.85 shares no
band with probability 7e-9); the low two bits of the minima, packed into five longs, estimate similarity with their chance
collisions taken out, and candidates far below the threshold are dropped; all others are confirmed on full sets.

Documents with the same set are one class. In each bucket the members are first compared with its smallest class, links
are joined to components, and only buckets whose other members still lie in several components are compared further, in
blocks of bounded size. No pairs within a group of copies are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, groups_of, lower_words, map_rows, mix, text_bytes, window_hashes, write_table
from .vocab import with_row_ids

WORDS, BANDS, ROWS = 5, 32, 5
N_MINIMA = BANDS * ROWS
#: Standard deviations that an estimate may lie below the threshold without the pair being dropped.
SLACK = 6.0
#: Classes in a block that one task compares with another block.
BLOCK = 256
#: Keys whose rows are kept out of shuffles by that key, rows of a frequent centre that go to one task, and rows (two longs)
#: of a table that goes to all tasks.
HOT_KEYS, CHUNK, IN_PLACE = 10_000, 1024, 1_000_000
_random = np.random.default_rng(20240229)
_XOR = _random.integers(0, 1 << 32, N_MINIMA, np.uint32)[:, None]
_MULTIPLY = _random.integers(0, 1 << 31, N_MINIMA, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def shingle_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of ``n`` words; the whole sequence as one if there are fewer."""
    return np.unique(window_hashes(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of 160 hash functions over a set."""
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(N_MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        values = _XOR ^ h[None, at : at + 512]
        values *= _MULTIPLY
        np.minimum(least, values.min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> tuple[list[int], list[int]]:
    """Two low bits of each (mixed) minimum, packed into longs, and a hash of each band."""
    m = least ^ (least >> np.uint32(16))
    m = m * np.uint32(0x85EBCA6B)
    m ^= m >> np.uint32(13)
    bits = np.stack([m & 1, (m >> 1) & 1], axis=1).astype(np.uint8)
    packed = np.packbits(bits.ravel(), bitorder="little").view(np.int64)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least.reshape(BANDS, ROWS)[:, k])
    return packed.tolist(), h.view(np.int64).tolist()


def least_matches(similarity: float) -> int:
    """Matching two-bit values, of ``N_MINIMA``, that a pair with ``similarity`` falls short of by SLACK deviations only."""
    p = similarity + (1 - similarity) / 4
    return int(np.floor(N_MINIMA * p - SLACK * np.sqrt(N_MINIMA * p * (1 - p))))


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matching two-bit values between each row of ``a`` and each row of ``b`` (rows of five longs)."""
    n = np.full((len(a), len(b)), N_MINIMA, np.int16)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        n -= np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).astype(np.int16)
    return n


def estimate(matching: int) -> float:
    """Similarity from matching two-bit values, corrected for the quarter that match by chance."""
    return (matching / N_MINIMA - 0.25) / 0.75


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b|, for sorted distinct arrays."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    common = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return den * common >= num * (len(a) + len(b) - common)


def _sets(rows: Iterator[tuple]):
    hashes = WordHashes()
    for row, doc_id, data in rows:
        s = shingle_set(hashes(lower_words(data)))
        if len(s):
            packed, bands = signature(minima(s))
            yield row, doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), packed, bands
        else:
            yield row, doc_id, 0, None, None, None


def _held(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and for broadcast if it has IN_PLACE rows at most; a larger one is joined by a shuffle."""
    table = write_table(df, name)
    return F.broadcast(table) if table.count() <= IN_PLACE else table


def _joined(rows: DataFrame, looked: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with what ``looked`` has for their ``key``; keys with the most rows by ``counts`` (key, n) are looked up in place.

    No shuffle then brings the rows of a large group together: any other key has at most one in HOT_KEYS of all rows.
    """
    large = F.broadcast(write_table(counts.orderBy(F.desc("n")).limit(HOT_KEYS).select(key), "large"))
    often = rows.join(F.broadcast(looked.join(large, key, "left_semi")), key)
    return often.unionByName(rows.join(large, key, "left_anti").join(looked.join(large, key, "left_anti"), key, how), allowMissingColumns=True)


def bucketed(reps: DataFrame) -> DataFrame:
    """(band, center, cid): the classes of every band that two share at least, with the least of them.

    The least class comes from partial minima, so a band that many classes share makes no large task.
    """
    every = reps.select(F.explode("bands").alias("band"), "cid")
    least = every.groupBy("band").agg(F.min("cid").alias("center"), F.count("*").alias("n")).where("n >= 2").select("band", "center")
    return every.join(_held(least, "bands"), "band").select("band", "center", "cid")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component is named by its least node.

    Large-star and small-star steps in turn; each round is written to the shared folder.
    """
    edges = write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(low, large["u"] == low["n"]).select("v", "u", "m")
        edges = write_table(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now


def _longs(values) -> np.ndarray:
    return np.array(values, np.int64).view(np.uint64)


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, component, first) of every row of ``docs`` (doc_id long, text).

    Sets of five-word shingles are linked where den * |intersection| >= num * |union|; component_id is the least doc_id
    of the component (null only if all are), ``component`` a number of it, and ``first`` marks one row of each component:
    the one with the least doc_id (null last), then row. Null texts and texts without words are linked with nothing.
    Copies, repeated rows included, form one class and are not compared. Texts of any length are read whole; other columns
    are ignored; an empty table gives no rows. ``row`` names a column
    that numbers the rows of a table which reads alike each time; without it rows are numbered in a written copy.
    """
    bar = least_matches(num / den)
    if row:
        texts = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long"), text_bytes().alias("text"))
    else:
        texts = write_table(with_row_ids(docs).withColumn("doc_id", F.col("doc_id").cast("long")).select("row", "doc_id", "text"), "documents")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
    sets = write_table(map_rows(texts, lambda: _sets, schema, "row long, doc_id long, n long, key binary, sig array<long>, bands array<long>", 1024), "sets")
    classes = write_table(sets.where("n > 0").groupBy("key").agg(F.min("row").alias("cid"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "classes")
    reps = write_table(sets.join(classes.select(F.col("cid").alias("row")), "row").select(F.col("row").alias("cid"), "n", "sig", "bands"), "reps")

    buckets = write_table(bucketed(reps), "buckets")
    wanted = _held(buckets.select(F.col("cid").alias("row")).distinct(), "wanted")
    one = pa.schema([("cid", pa.int64()), ("members", pa.binary())])

    def full(rows):
        hashes = WordHashes()
        return ((row, shingle_set(hashes(lower_words(data))).tobytes()) for row, data in rows)

    members = write_table(map_rows(texts.join(wanted, "row", "left_semi").select("row", "text"), lambda: full, one, "cid long, members binary", 256), "members")

    # members against the least class of each bucket
    brief = reps.select("cid", "sig")
    same = F.lit(N_MINIMA)
    for k in range(2 * N_MINIMA // 64):
        x = F.col("a.sig")[k].bitwiseXOR(F.col("b.sig")[k])
        same = same - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    stars = buckets.where("center <> cid").select("center", "cid").distinct()
    stars = stars.join(brief.alias("a"), F.col("center") == F.col("a.cid")).select("center", stars["cid"], F.col("a.sig").alias("sig")).alias("a").join(brief.alias("b"), F.col("a.cid") == F.col("b.cid")).where(same >= bar).select("center", F.col("a.cid").alias("cid"))
    stars = write_table(stars, "stars")
    often = stars.groupBy("center").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).orderBy(F.desc("n")).limit(HOT_KEYS)
    hot = F.broadcast(write_table(often.select("center", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "hot-centers"))
    chunks = F.coalesce("chunks", F.lit(1))
    # one row with the centre's set leads the rows with its members' sets, in chunks of a bounded number of rows
    leads = stars.select("center").distinct().join(hot, "center", "left").select("center", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(None).cast("long").alias("other"), F.col("center").alias("cid"))
    dealt = stars.join(hot, "center", "left").select("center", F.pmod(F.xxhash64("cid"), chunks).cast("int").alias("chunk"), F.col("cid").alias("other"), "cid")
    held = dealt.unionByName(leads).join(members, "cid").select("center", "chunk", "other", "members")
    held = held.repartition("center", "chunk").sortWithinPartitions("center", "chunk", F.col("other").asc_nulls_first())
    pair = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def confirm(rows):
        theirs = None
        for center, _, other, members in rows:
            if other is None:
                theirs = np.frombuffer(members, np.uint64)
            elif linked(theirs, np.frombuffer(members, np.uint64), num, den):
                yield center, other

    links = write_table(map_rows(held, lambda: confirm, pair, "u long, v long"), "links")
    parts = components(links)

    # what is left: buckets whose members, but the least, lie in several components
    named = buckets.where("center <> cid").join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("band", "cid", F.coalesce("component", "cid").alias("component"))
    named = write_table(named, "named")
    several = named.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a < b").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("n_blocks"))
    open_ = named.join(several, "band").join(reps.select("cid", "sig", "bands"), "cid")
    active = write_table(_block_pairs(open_, ["sig", "bands"]).transform(lambda d: map_rows(d, lambda: lambda rows: _active(rows, bar), pa.schema([("band", pa.int64()), ("cid", pa.int64())]), "band long, cid long")).distinct(), "active")
    again = active.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    close = active.join(again, "band").join(named, ["band", "cid"]).join(reps.select("cid", "sig", "bands"), "cid").join(members, "cid")
    more = map_rows(_block_pairs(close, ["sig", "bands", "members"]), lambda: lambda rows: _confirm_blocks(rows, bar, num, den), pair, "u long, v long")
    more = write_table(more, "more")
    parts = write_table(components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "components")

    classed = classes.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")).drop("n")
    classed = write_table(classed, "classed")
    least = classed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cid")).alias("m"))
    least = least.select("component", "component_id", F.col("m.cid").alias("holder"))
    by_key = _joined(classed, least, "component", classed.groupBy("component").agg(F.count("*").alias("n")))
    by_key = by_key.select("key", "component", "component_id", (F.col("holder") == F.col("cid")).alias("holds"))
    # within the class that holds the component's least doc_id: its first row with that doc_id
    firsts = sets.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m")).select("key", F.col("m.row").alias("first_row"))
    by_key = write_table(by_key.join(firsts, "key"), "by-key")
    out = _joined(sets.select("row", "doc_id", F.col("n").alias("n_shingles"), "key"), by_key, "key", classes.select("key", "n"), "left")
    alone = F.col("key").isNull()
    return out.select("row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("row")).otherwise(F.col("component")).alias("component"), (alone | (F.col("holds") & (F.col("row") == F.col("first_row")))).alias("first"))


def _block_pairs(open_: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (band, i, j, block, cid, component, ...) sorted by pair of blocks: each class goes to the pairs that hold its block."""
    block = F.pmod(F.xxhash64("cid", F.lit(7)), F.col("n_blocks")).cast("int")
    dealt = open_.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "component", *columns)
    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "block", "cid")


def _close(group: list[tuple], band: int, bar: int):
    """Indices (into ``group``) of candidate pairs of a pair of blocks that lie in other components, this band being their first."""
    i, j = group[0][1:3]
    block = np.array([r[3] for r in group])
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    sig, comp = _longs([r[6] for r in group]), np.array([r[5] for r in group])
    bands = np.array([r[7] for r in group], np.int64)
    for at in range(0, len(a), 512):
        mine = a[at : at + 512]
        near = (matches(sig[mine], sig[b]) >= bar) & (comp[mine][:, None] != comp[b][None, :])
        x, y = np.nonzero(near)
        x, y = mine[x], b[y]
        if i == j:
            x, y = x[x < y], y[x < y]
        if len(x):
            equal = bands[x] == bands[y]
            once = bands[x, equal.argmax(axis=1)] == band
            yield x[once], y[once]


def _active(rows: Iterator[tuple], bar: int):
    for (band, _, _), group in groups_of(rows, 3):
        got: set[int] = set()
        for x, y in _close(group, band, bar):
            got.update(x.tolist(), y.tolist())
        yield from ((band, group[k][4]) for k in sorted(got))


def _confirm_blocks(rows: Iterator[tuple], bar: int, num: int, den: int):
    """Links between components found in a pair of blocks, none between components that its links already join."""
    for (band, _, _), group in groups_of(rows, 3):
        parent: dict[int, int] = {}

        def root(c):
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        members = [np.frombuffer(r[8], np.uint64) for r in group]
        for xs, ys in _close(group, band, bar):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                a, b = root(group[x][5]), root(group[y][5])
                if a != b and linked(members[x], members[y], num, den):
                    parent[a] = b
                    yield group[x][4], group[y][4]
