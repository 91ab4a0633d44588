"""Best-fit packing of documents into sequences of bounded length, with certified bin counts.

Documents are tokenised once; only lengths are packed. Partitions of at most ``PART_ROWS`` pieces are packed by best-fit
decreasing and certified by dual-feasible-function lower bounds. Partitions above their bound put the pieces of their
unfilled bins together, certified ones those of their emptiest bin (so that rounding up costs no bin a partition). These
pieces are dealt anew, again at most ``PART_ROWS`` to a partition, and packed again, until they fit one partition or a
round over as many partitions as before saves no bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, map_rows, text_bytes, write_table
from .tokens import IdBytes, tokenizer_path

#: Pieces that one task packs at once (on average over the tasks of a round, which are dealt by hash).
PART_ROWS = 100_000
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str | None = None, limit: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and ``end_id``, cut where longer than ``limit``.

    A null or empty text has the end id alone. ``ids`` holds little-endian unsigned 32-bit ids.
    """
    path = path or tokenizer_path()
    end = end_id.to_bytes(4, "little")

    def make():
        ids = IdBytes(path)

        def run(rows):
            for doc_id, data in rows:
                got = ids(data) + end
                for k, at in enumerate(range(0, len(got), 4 * limit)):
                    part = got[at : at + 4 * limit]
                    yield (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ())

        return run

    schema, ddl = (PIECES.append(pa.field("ids", pa.binary())), PIECES_DDL + ", ids binary") if with_ids else (PIECES, PIECES_DDL)
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")), make, schema, ddl, 1024)


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length, and the room left in each bin. Open bins are kept by room; a bit set finds the least that fits."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    open_rooms, room = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r = len(room), limit
            room.append(limit)
        bins[i], offsets[i], room[b] = b, limit - r, r - n
        by_room[r - n].append(b)
        open_rooms |= 1 << (r - n)
    return bins, offsets, room


def lower_bound(lengths: np.ndarray, limit: int) -> int:
    """The best bound of two families of dual feasible functions over the histogram of lengths.

    For eps up to half the limit: lengths over limit - eps count as whole bins, those under eps as nothing. For k up to 32:
    a length x counts as x (k + 1) / limit if that is whole, else as floor(x (k + 1) / limit) * limit / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=limit + 1).astype(np.int64)
    size = np.arange(limit + 1, dtype=np.int64)
    number, total = np.cumsum(count), np.cumsum(count * size)
    eps = np.arange(0, limit // 2 + 1)
    large = number[limit] - number[limit - eps]
    middle = total[limit - eps] - np.where(eps > 0, total[np.maximum(eps - 1, 0)], 0)
    best = int((large + -(-middle // limit)).max())
    for k in range(1, 33):
        whole = size * (k + 1) % limit == 0
        twice = np.where(whole, size * k, size * (k + 1) // limit * limit)  # in units of 1 / (limit k)
        best = max(best, -(-int((count * twice).sum()) // (limit * k)))
    return best


def _packed(rows: Iterable[tuple], limit: int, last: bool) -> Iterator[tuple]:
    """Rows (part, id, length) sorted by part -> (part, id, length, bin, offset, again)."""
    for (part,), group in groups_of(iter(rows), 1):
        lengths = np.fromiter((r[2] for r in group), np.int64, len(group))
        bins, offsets, room = best_fit_decreasing(lengths, limit)
        gap = not last and len(room) > lower_bound(lengths, limit)
        emptiest = -1 if last else int(np.argmax(room))
        for r, b, o in zip(group, bins.tolist(), offsets.tolist(), strict=True):
            yield part, r[1], r[2], b, o, room[b] > 0 and (gap or b == emptiest)


def _parts(rows: int, part_rows: int) -> int:
    return max(1, -(-rows // part_rows))


def pack(pieces: DataFrame, limit: int = 4096, part_rows: int = PART_ROWS) -> DataFrame:
    """``pieces`` (a stable table with a length of 1 to ``limit``) with sequence_id and offset, in as few sequences as found.

    Empty input gives no rows. Equal lengths are interchangeable; ties go by row order.
    """
    numbered = write_table(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == limit
    full = numbered.where(whole).select("id", (-1 - F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = numbered.where(~whole).select("id", "length")
    level, done, before = 0, [full], None
    n_parts = _parts(todo.count(), part_rows)
    todo = todo.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int"))
    while True:
        schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("length", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("again", pa.bool_())])
        dealt = todo.select("part", "id", "length").repartition(n_parts, "part").sortWithinPartitions("part", "id")
        last = n_parts == 1
        out = write_table(map_rows(dealt, lambda last=last: lambda rows: _packed(rows, limit, last), schema, "part int, id long, length long, bin long, offset long, again boolean", 65536), f"packed-{level}")
        sequence = F.lit(level << 57) + F.shiftleft(F.col("part").cast("long"), 24) + F.col("bin")
        placed = out.select("id", sequence.alias("sequence_id"), "offset", "again")
        bins, rows, open_bins = out.groupBy("part", "bin").agg(F.max("again").alias("again"), F.count("*").alias("n")).agg(F.count("*"), F.sum(F.when(F.col("again"), F.col("n"))), F.count_if("again")).first()
        if last or not rows or (_parts(rows, part_rows) >= n_parts and before is not None and bins >= before):
            done.append(placed.drop("again"))
            break
        done.append(placed.where(~F.col("again")).drop("again"))
        n_parts, before = _parts(rows, part_rows), open_bins
        level += 1
        todo = out.where("again").select("id", "length").withColumn("part", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(n_parts)).cast("int"))
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    return numbered.join(placed, "id").drop("id")


def packed_documents(docs: DataFrame, path: str | None = None, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every document of ``docs`` (doc_id, text).

    Null texts count as empty and repeated rows are packed each; texts of any length are tokenised whole; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows.
    """
    return pack(token_pieces(docs, path, limit, end_id), limit)


def packed_sequences(docs: DataFrame, path: str | None = None, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """(sequence_id, ids binary, length): the packed sequences themselves, as little-endian unsigned 32-bit ids."""
    packed = pack(token_pieces(docs, path, limit, end_id, with_ids=True), limit)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), "length")
