"""10. Best-fit packing by exact-complement hashing.

Every document's ids (with an end id) are cut into pieces of at most ``capacity`` ids. The plan needs only how many
pieces there are of each length, so it is made from a histogram of at most ``capacity`` counts. From the longest
length down, combinations of one, two or three lengths that exactly fill the gap are looked up in an index of single,
pair and triple sums and consumed in bulk, as far as all their lengths are available; what has no complement goes to the
sequence with the tightest gap. Complements of many short lengths may take what best fit needs later, so the plan is also made
with pairs first, with pairs or singles at most, and by best fit alone, and the one of fewest sequences counts. The plan is a
bounded table (length, ranks) -> sequences, which places all pieces in parallel.

Cases: null or empty text: one piece holding the end id alone; empty table: no rows; repeated rows: each is packed on
its own; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlake.llm.common import checkpointed
from flowlake.llm.tokens import crc32_ids, encoder, vocabulary_path

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that a task ranks, about, and slots that pieces of one length are dealt to at most.
SLOT_ROWS, MOST_SLOTS = 100_000, 1 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).encode_many, np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(piece), crc32_ids(piece)))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(cut, _PIECES)


class SumIndex:
    """Lengths and pairs of lengths by their sum, built once; an entry leaves once a length of it is used up, for good, as
    counts only fall. Triples are a single and a pair by their sum, so they need no entries of their own."""

    def __init__(self, left: np.ndarray):
        self.left = left
        present, capacity = np.flatnonzero(left), len(left) - 1
        kind = np.int16 if capacity < 1 << 14 else np.int32
        # the shorter lengths that still fit beside each length: at most capacity^2 / 4 pairs, in few bytes a length
        beside = [present[: np.searchsorted(present, min(n, capacity - n), side="right")].astype(kind) for n in present.tolist()]
        large = np.repeat(present.astype(kind), [len(b) for b in beside])
        small = np.concatenate([np.empty(0, dtype=kind), *beside])
        sums = large + small
        # of one sum, the pair that can be taken most often comes first
        often = np.where(large == small, left[small] // 2, np.minimum(left[large], left[small]))
        order = np.argsort((sums.astype(np.int64) << 40) - np.minimum(often, (1 << 40) - 1), kind="stable")
        self.large, self.small = large[order], small[order]
        bounds = np.searchsorted(sums[order], np.arange(len(left) + 1))
        self.at, self.end = bounds[:-1].copy(), bounds[1:]

    def _able(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[n] >= lengths.count(n) for n in lengths)

    def pair(self, gap: int) -> tuple[int, int] | None:
        """The first pair of this sum whose lengths are left."""
        at, end, left = int(self.at[gap]), int(self.end[gap]), self.left
        while at < end:
            large, small = self.large[at : min(at + 256, end)], self.small[at : min(at + 256, end)]
            able = np.flatnonzero((left[large] > 0) & (left[small] > 0) & ((large != small) | (left[large] > 1)))
            if len(able):
                self.at[gap] = at + able[0]
                return int(large[able[0]]), int(small[able[0]])
            at += len(large)
        self.at[gap] = end
        return None

    def complement(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """One, two or three available lengths (``most`` at most) with the sum ``gap``."""
        if self.left[gap]:
            return (gap,)
        if most == 1:
            return None
        if (found := self.pair(gap)) is not None or most == 2:
            return found
        # singles that are left, and whose rest has pairs left, from the longest on
        singles = np.flatnonzero(self.left[:gap])
        rests = gap - singles
        for single in singles[self.at[rests] < self.end[rests]][::-1].tolist():
            rest = gap - single
            if self.pair(rest) is None:
                continue
            for i in range(self.at[rest], self.end[rest]):
                found = single, int(self.large[i]), int(self.small[i])
                if self._able(found):
                    return found
        return None


#: Turns of complements of so many lengths at most, before best fit; plans are made with each.
TURNS = ((3,), (2, 3), (2,), (1,), ())


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) that use up ``counts``; its size does not grow with counts."""
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best, fewest = [], None
    for turns in TURNS:
        plan = _plan(counts, capacity, turns)
        n = sum(times for _, times in plan)
        if fewest is None or n < fewest:
            best, fewest = plan, n
        if fewest == least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, turns: tuple[int, ...]) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        done.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for most in turns:
        sums = SumIndex(left)
        for length in range(capacity - 1, 0, -1):
            while left[length]:
                left[length] -= 1
                found = sums.complement(capacity - length, most)
                left[length] += 1
                if found is None:
                    break
                uses = np.bincount((length, *found), minlength=capacity + 1)
                used = np.flatnonzero(uses)
                times = int((left[used] // uses[used]).min())
                left[used] -= times * uses[used]
                done.append(((length, *found), times))
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, dtype=np.int64)  # gap -> open sequences with it

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        open_bins.setdefault(gap, []).append((lengths, times))
        gaps[gap] += times

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fit = np.flatnonzero(gaps[length:])
            if len(fit):
                gap = int(fit[0]) + length
                lengths, times = open_bins[gap].pop()
                gaps[gap] -= times
                take = min(n, times)
                put((*lengths, length), take)
                if times > take:
                    put(lengths, times - take)
                n -= take
            else:
                each = min(capacity // length, n)
                put((length,) * each, n // each)
                n %= each
    return done + [x for rows in open_bins.values() for x in rows]


def allocation(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ascending: the pieces of a length from that rank on go, one
    to each, to the sequences from that one on."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, length, ...)."""
    spark = pieces.sparkSession
    # the commonest length may hold most pieces: as many slots as give each a bounded share of it
    most = pieces.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    spread = min(MOST_SLOTS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), most // SLOT_ROWS))
    slots = pieces.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int"))
    # at most capacity rows go to the driver, whatever the input; the bases of the slots stay a table
    sizes = checkpointed(slots.groupBy("length", "_slot").agg(F.count("*").alias("_n")))
    ahead = Window.partitionBy("length").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_slot", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = allocation(plan_patterns(counts, capacity))
    keys = (table[:, 0] << 45) + table[:, 1]
    names = pieces.columns
    order = Window.partitionBy("length", "_slot").orderBy("doc_id", "piece")
    ranked = slots.withColumn("_rank", F.row_number().over(order).cast("long") - 1).join(bases, ["length", "_slot"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base"))
    shared = spark.sparkContext.broadcast((table, keys))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys = shared.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, (length << 45) + rank, side="right") - 1] if len(rank) else np.empty((0, 4), dtype=np.int64)
            arrays = [b.column(n) for n in names] + [pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    schema = pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> one row a piece with its place. The pieces are kept, since plan and placing both read them."""
    return pack(checkpointed(cut_pieces(docs, vocabulary or vocabulary_path())))
