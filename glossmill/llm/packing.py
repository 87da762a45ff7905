"""Best-fit packing of tokenised documents into training sequences.

Planning works on the histogram of piece lengths, never on documents: best-fit decreasing places whole groups
of equal lengths into groups of equally filled sequences. Its plan is a table of slot ranges per length, bounded
by the sequence length and not by the corpus. Documents then take slots by joining on their rank within their
length. Ranks come from counts per task and length, so no length, however common, meets in one task.

Cases: null or empty text is a document of one end token. Rows with the same doc_id are packed each on their own.
A null doc_id is packed too and stays null. No rows: no sequences. Other columns are ignored, whatever their name.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.session import frugal
from glossmill.llm.tokens import encoder
from glossmill.llm.workspace import Workspace

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, task int, nth long"
#: More slot ranges than this (some 4 MB) are joined by a shuffle; a plan of 2048 lengths has a few thousand. Likewise
#: the first ranks of the tasks, of which there are at most as many as lengths for each task.
BROADCAST_RANGES = 100_000
RANGE = "length int, rank_from long, rank_to long, sequence_from long, per_sequence int, place int"


@dataclass(frozen=True)
class SlotRange:
    """Ranks [rank_from, rank_to) of one length fill sequences from sequence_from on, per_sequence in each, the
    first of them at offset place."""

    length: int
    rank_from: int
    rank_to: int
    sequence_from: int
    per_sequence: int
    place: int


def plan(histogram: dict[int, int], size: int) -> list[SlotRange]:
    """Best-fit decreasing over counts: each length, from the longest, goes where it leaves the least room.

    A group is a number of sequences with the same filling, held as a linked list of (length, copies).
    """
    room: dict[int, list[tuple[int, tuple | None]]] = {}
    open_rooms: list[int] = []  # a heap of the rooms that have groups

    def put(left: int, count: int, filling: tuple) -> None:
        if left not in room:
            room[left] = []
            heapq.heappush(open_rooms, left)
        room[left].append((count, filling))

    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"no piece of length {length} fits into {size}")
        left = histogram[length]
        tight = []
        while left and open_rooms:
            space = open_rooms[0]
            if space < length:
                tight.append(heapq.heappop(open_rooms))
                continue
            fit = space // length
            count, filling = room[space].pop()
            used = min(count, left // fit)
            if used:
                put(space - fit * length, used, (length, fit, filling))
                left -= used * fit
                if count > used:
                    room[space].append((count - used, filling))
            else:  # fewer are left than one sequence takes
                put(space - left * length, 1, (length, left, filling))
                left = 0
                if count > 1:
                    room[space].append((count - 1, filling))
            if not room[space]:
                del room[space]
                open_rooms.remove(space)
                heapq.heapify(open_rooms)
        for space in tight:
            heapq.heappush(open_rooms, space)
        fit = size // length
        if left // fit:
            put(size - fit * length, left // fit, (length, fit, None))
        if left % fit:
            put(size - (left % fit) * length, 1, (length, left % fit, None))

    ranges, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for _, members in sorted(room.items()):
        for count, filling in members:
            place, chain = 0, []
            while filling:
                chain.append(filling[:2])
                filling = filling[2]
            for length, copies in reversed(chain):
                ranges.append(SlotRange(length, taken[length], taken[length] + count * copies, sequence, copies, place))
                taken[length] += count * copies
                place += copies * length
            sequence += count
    return ranges


def pieces(documents: DataFrame, tokenizer: str, size: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Each document's ids in pieces of ``size``, of which only the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                first = (len(ids) - 1) % size + 1
                for n, stop in enumerate(range(first, len(ids) + 1, size)):
                    begin = max(0, stop - size)
                    raw = ids[begin if n else 0 : stop].tobytes()
                    length = len(raw) // 4
                    rows.append((key, n, stop - length, length, zlib.crc32(raw), raw if keep_ids else None, task, seen[length]))
                    seen[length] += 1
                if len(rows) >= 4096:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(cut), PIECES)


def _frame(spark: SparkSession, slots: list[SlotRange]) -> DataFrame:
    """The ranges as a local table. Rows of Python would be read by workers of another daemon, which stay in the executors."""
    kinds = {"long": pa.int64(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in RANGE.split(", ")), strict=True)
    columns = [pa.array([getattr(x, name) for x in slots], kinds[kind]) for name, kind in zip(names, types, strict=True)]
    return spark.createDataFrame(pa.table(columns, names=list(names)), RANGE)


def pack(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Packs (doc_id, text): one row per piece with its sequence_id and its offset there.

    With keep_ids the ids themselves come along, as little-endian unsigned 32-bit bytes; see ``sequences``.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "packing")
    cut = work.cut(pieces(documents, tokenizer, size, end_id, keep_ids), "pieces")
    held = work.cut(cut.groupBy("length", "task").agg(F.count("*").alias("held")), "held")
    lengths = held.groupBy("length").agg(F.sum("held").alias("held"), F.count("*").alias("tasks")).collect()  # at most `size` rows
    histogram = {r["length"]: r["held"] for r in lengths}
    slots = plan(histogram, size)
    ranges = _frame(spark, slots)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "task", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("rank_0"))
    starts = F.broadcast(starts) if sum(r["tasks"] for r in lengths) <= BROADCAST_RANGES else starts.hint("merge")
    # A task's ranks of one length are an interval, so only the ranges that meet it are kept for it.
    rank = F.col("rank_0") + F.col("nth")
    r = ranges.withColumnRenamed("length", "range_length")
    if len(slots) <= BROADCAST_RANGES:
        r = F.broadcast(r)
    slot = rank - F.col("rank_from")
    return (
        cut.join(starts, ["length", "task"])
        .join(r, (F.col("length") == F.col("range_length")) & (rank >= F.col("rank_from")) & (rank < F.col("rank_to")))
        .select(
            "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
            (F.col("sequence_from") + F.floor(slot / F.col("per_sequence"))).cast("long").alias("sequence_id"),
            (F.col("place") + F.pmod(slot, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
            *(["ids"] if keep_ids else []),
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, n_tokens, ids (bytes), doc_ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, 0L, (a, x) -> a + x.length)").alias("n_tokens"),
        F.expr("aggregate(parts, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.col("parts.doc_id").alias("doc_ids"),
    )
