"""1. N-gram Jaccard join by grouped prefixes.

A document is the set of its shingles: three words in the numbered query, as many as ``width`` says elsewhere. Documents
with equal sets are one class. Of a set of n shingles in a global order, only the first n - ceil(similarity x n) + 1 (its
prefix) need a partner's prefix in common. Classes with the same prefix and size are one group. Groups alone are listed by
their prefix shingles; pairs of groups in a list are dropped by size and by the bitmaps of their leaders (a group's radius
is what its members lie apart from the leader at most). Only groups left in pairs are expanded to their members, whose
pairs are filtered in the same way and verified over whole texts.

- The order puts frequent shingles last, so a passage that many documents share makes no long list. Which ones those
  are is counted over all documents; the order itself never changes the result.
- Parity bitmaps of two sets differ in at most as many bits as the sets differ in shingles, so a pair is dropped early
  only if it cannot link. Long sets have a wide bitmap besides.
- Lists with few pairs hand on all of them. In lists with many (dense: clusters of near copies) each row proposes only the
  partner that comes first in an order common to all lists, so a cluster of m rows costs about m pairs. What these link
  become components, and dense lists are listed again for pairs of different components only, in turn, until the last
  turn hands on all pairs that are left: no link is lost, and a list of one component is dropped whole.
- A list of any length is cut into blocks, each a task's work of its own. In the first turn its first row in that order meets
  all blocks; later, chunks of the rows outside the list's largest component meet all chunks, each two in one block.

Cases: null and wordless texts have no shingles and stand alone; fewer words than a shingle has are one shingle; repeated rows
and equal texts are one class; rows of one doc_id, or without one, are linked by their own texts only, as classes and not
ids are the vertices; a component is named by its lowest doc_id, so rows without one get a null component unless linked to
another; other columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from flowlake.llm.common import kept
from flowlake.llm.hashing import chunks, mix, words_of
from flowlake.plans.components import component_labels

#: The numbered query links documents whose sets of three-word shingles are 90 % the same.
WIDTH, SIMILARITY = 3, 0.9
#: Shingles in more lists than this go last in the order; at most FREQUENT of them, the most frequent.
RARE, FREQUENT = 4, 1 << 20
#: How many prefixes long the part of a set is in which frequent shingles are counted, as prefixes then reach further.
COUNTED = 1.6
BITMAP_BITS = 512
#: Bits of the filter of ids whose texts are wanted: 1 MB, whatever the input.
FILTER_BITS = 1 << 23
#: Rows of a list that one task compares with each other.
BLOCK = 4096
#: A list with more pairs than rows, and than this, is dense.
SPARSE = 10
#: Turns over dense lists by proposals, before the turn that hands on all pairs left.
TURNS = 1
#: Of the lists a row stands in, the first are known to it: of lists that two rows share, the first hands their pair on.
FIRST_LISTS = 16
#: Partners of one text that are verified by one task.
HUB_ROWS = 256


def percent_of(similarity: float) -> int:
    """Similarities are whole per cents, so all bounds are whole numbers."""
    percent = round(similarity * 100)
    if not 0 < percent <= 100 or abs(percent - similarity * 100) > 1e-6:
        raise ValueError(f"similarity must be a whole per cent above 0: {similarity}")
    return percent


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def most_different(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of sizes a and b: 100 x intersection >= percent x union."""
    return a + b - 2 * ((percent * (a + b) + 99 + percent) // (100 + percent))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    for first, last in chunks(raw):
        grams = words_of(raw[first:last]).ngrams(width)
        for i in range(last - first):
            yield np.unique(grams.of(i))


def batch_sets(texts: pa.Array, width: int, slice_rows: int = 500) -> Iterator[np.ndarray]:
    """The same for an Arrow column, a slice at a time."""
    for at in range(0, len(texts), slice_rows):
        yield from shingle_sets(texts.slice(at, slice_rows).to_pylist(), width)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mix(s + np.uint64(11)), mix(s ^ np.uint64(0x5851F42D4C957F2D))))


def bitmap(s: np.ndarray, bits: int = BITMAP_BITS) -> bytes:
    odd = np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_bitmap(s: np.ndarray) -> bytes:
    """At least two bits a shingle, so long sets are told apart too; a power of two, so halves fold onto each other."""
    return bitmap(s, max(BITMAP_BITS, 1 << (2 * len(s) - 1).bit_length()))


def _member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if len(table) == 0:
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def frequent_shingles(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """Ascending hashes of the most frequent shingles among the first of each document's set."""

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            for s in batch_sets(b.column(2), width):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    out.append(s[: max(prefix_size(len(s), percent), int(len(s) * COUNTED * (100 - percent) / 100))])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["h"])

    counts = docs.mapInArrow(first_ones, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > RARE)
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()["h"].to_numpy()
    return np.sort(top.view(np.uint64))


def sketches(docs: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, row, n, d1, d2 of every document; prefix and bitmaps too of the first document of a class in each partition."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            rows = []
            for s in batch_sets(b.column(2), width):
                d = digest(s)
                if len(s) == 0 or d in seen:
                    rows.append((len(s), *d, None, None, None))
                    continue
                seen.add(d)
                late = _member(last, s)
                order = np.concatenate([s[~late], s[late]])[: prefix_size(len(s), percent)]
                wide = wide_bitmap(s)
                # a set that needs no wider bitmap has it once only
                rows.append((len(s), *d, order.view(np.int64), bitmap(s), wide if len(wide) * 8 > BITMAP_BITS else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "row", "n", "d1", "d2", "prefix", "bitmap", "wide"])

    return docs.mapInArrow(sketch, "doc_id long, row long, n long, d1 long, d2 long, prefix array<long>, bitmap binary, wide binary")


def grouped_classes(sketched: DataFrame) -> DataFrame:
    """One row a class: g1, g2 (name its group), size, prefix, bitmaps, the key of one of its rows and vertex v. The vertex
    is a number of its own, so these rows must be kept before they are read twice."""
    rows = sketched.where("prefix is not null")
    rows = rows.groupBy("d1", "d2").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "prefix", "bitmap", "wide")))
    rows = rows.withColumn("g1", F.xxhash64("n", "prefix")).withColumn("g2", F.xxhash64(F.lit("second"), "n", "prefix"))
    return rows.withColumn("v", F.monotonically_increasing_id())


def groups_of(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups: v (of the leader), n, prefix, bitmap, members, radius; and the members of those with several: leader, v."""
    several = classes.groupBy("g1", "g2").agg(F.count("*").alias("members"), F.min("v").alias("leader")).where("members > 1")
    several = kept(several, "groups")
    members = classes.select("v", "g1", "g2", "bitmap").join(several, ["g1", "g2"])
    leaders = members.where("v = leader").select("leader", F.col("bitmap").alias("first"))

    @F.pandas_udf(IntegerType())
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.bitwise_count(_words(a.tolist()) ^ _words(b.tolist())).sum(axis=1, dtype=np.int32))

    radius = members.join(leaders, "leader").select("leader", apart("bitmap", "first").alias("apart")).groupBy("leader").agg(F.max("apart").alias("radius"))
    marks = kept(several.join(radius, "leader").select("g1", "g2", "leader", "members", "radius"), "groups")
    rows = classes.select("v", "g1", "g2", "n", "prefix", "bitmap").join(marks, ["g1", "g2"], "left").where("leader is null or leader = v")
    groups = rows.select("v", "n", "prefix", "bitmap", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("radius", F.lit(0)).alias("radius"))
    return groups, kept(members.select("leader", "v"), "members")


def turn_order(v: np.ndarray, turn: int) -> np.ndarray:
    """Numbers that order vertices, differently in each turn; in the first, lower vertices come first."""
    return (1 << 62) - v if turn == 0 else (mix((v + (turn << 48)).view(np.uint64)) >> np.uint64(2)).astype(np.int64)


def group_lists(groups: DataFrame) -> DataFrame:
    """token, block, blocks, v, n, bitmap, slack, several: the groups of each list with more than one."""
    posted = groups.select("v", F.explode("prefix").alias("token"))
    counts = posted.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    counts = counts.select("token", F.ceil(F.col("groups") / BLOCK).cast("int").alias("blocks"))
    rows = posted.join(counts, "token").withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
    # the first group of a list of several blocks meets all others
    firsts = rows.where("blocks > 1").groupBy("token", "blocks").agg(F.min("v").alias("v"))
    firsts = firsts.select("v", "token", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = rows.unionByName(firsts.where(F.pmod(F.xxhash64("v"), "blocks").cast("int") != F.col("block")))
    facts = groups.select("v", "n", "bitmap", F.col("radius").alias("slack"), (F.col("members") > 1).alias("several"))
    return rows.select("token", "block", "blocks", "v").join(facts, "v")


def member_lists(lists: DataFrame, labels: DataFrame, classes: DataFrame, every: bool = False) -> DataFrame:
    """The same columns (and wide, component, side) for lists(token, v) that hold several components. Rows outside a list's
    largest component and rows of it are cut into chunks of half a block; each chunk of outside rows meets itself (side -1) and
    every other chunk (sides 0 and 1) in one block, so each pair stands in one block only and no block has more than two
    chunks. A list of one block at most is not cut. With ``every``, first too: the first FIRST_LISTS of a row's lists."""
    rows = lists.join(labels.withColumnRenamed("id", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    parts = rows.groupBy("token", "component").agg(F.count("*").alias("n"))
    several = parts.groupBy("token").agg(F.sum("n").alias("rows"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("main"))
    chunks_of = lambda n: F.when(F.col("rows") <= BLOCK, 1).otherwise(F.ceil(n / (BLOCK / 2))).cast("long")
    several = several.where("parts > 1").select("token", (F.col("rows") > BLOCK).alias("cut"), chunks_of(F.col("rows") - F.col("main.n")).alias("outside"), chunks_of(F.col("main.n")).alias("inside"), F.col("main.component").alias("main"))
    rows = rows.join(several, "token").withColumn("blocks", F.when(F.col("cut"), F.col("outside") + F.col("inside")).otherwise(1))
    own = lambda n: F.pmod(F.xxhash64("v"), n)
    dealt = lambda first, last, side: F.struct((first * F.col("blocks") + last).alias("block"), side.cast("int").alias("side"))
    c = F.col("chunk")
    of_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("outside") - 1), lambda k: dealt(k, c, F.lit(1)))
    of_others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: dealt(F.least(c, k), F.greatest(c, k), F.when(k == c, -1).when(k > c, 0).otherwise(1)))
    whole = F.array(dealt(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(-1)))
    in_main = F.col("component") == F.col("main")
    rows = rows.withColumn("chunk", F.when(in_main, F.col("outside") + own(F.col("inside"))).otherwise(own(F.col("outside"))))
    rows = rows.withColumn("_d", F.explode(F.when(~F.col("cut"), whole).when(in_main, of_main).otherwise(of_others)))
    rows = kept(rows.select("token", "_d.block", F.col("blocks").cast("long").alias("blocks"), "_d.side", "v", "component"), "rows")
    facts = facts_of(classes, rows.select("v")).select("v", "n", "bitmap", F.lit(0).alias("slack"), F.lit(False).alias("several"), "wide")
    if every:
        facts = facts.join(rows.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("token")), 1, FIRST_LISTS).alias("first")), "v")
    return rows.join(facts, "v")


def facts_of(classes: DataFrame, vertices: DataFrame) -> DataFrame:
    """The rows of classes that are named, kept: where these are few, Spark sends them to the classes and not the reverse."""
    named = kept(vertices.distinct(), "named")
    return kept(classes.select("v", "row", "d1", "d2", "n", "bitmap", "wide").join(named, "v", "left_semi"), "facts")


def _words(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<u8").reshape(len(blobs), -1) if blobs else np.empty((0, 1), dtype=np.uint64)


class WideBitmaps:
    """Bitmaps of several widths; two are compared at the narrower one's width, to which the wider is folded."""

    def __init__(self, blobs: list[bytes]):
        self.width = np.array([len(b) for b in blobs], dtype=np.int64)
        self.blobs = blobs
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each row in the table of bitmaps folded to ``width``, and that table."""
        if width not in self.tables:
            rows = np.flatnonzero(self.width >= width)
            place = np.full(len(self.width), -1)
            place[rows] = np.arange(len(rows))
            table = np.empty((len(rows), width // 8), dtype=np.uint64)
            for own in np.unique(self.width[rows]).tolist():
                these = np.flatnonzero(self.width[rows] == own)
                bits = _words([self.blobs[i] for i in rows[these].tolist()])
                while bits.shape[1] > width // 8:
                    half = bits.shape[1] // 2
                    bits = bits[:, :half] ^ bits[:, half:]
                table[these] = bits
            self.tables[width] = place, table
        return self.tables[width]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits rows x and y differ."""
        out = np.zeros(len(x), dtype=np.int64)
        widths = np.minimum(self.width[x], self.width[y])
        for width in np.unique(widths).tolist():
            place, table = self.at(width)
            these = np.flatnonzero(widths == width)
            step = max(1, (4 << 20) // width)
            for k in range(0, len(these), step):
                part = these[k : k + step]
                out[part] = np.bitwise_count(table[place[x[part]]] ^ table[place[y[part]]]).sum(axis=1, dtype=np.int64)
        return out


#: Stands where a row has fewer lists than FIRST_LISTS.
NO_LIST = np.iinfo(np.int64).max


class ListRows:
    """Rows of whole blocks of lists, sorted by list, block and size: the pairs that can link, and what to hand on."""

    def __init__(self, t: pa.Table, percent: int, turn: int):
        self.percent = percent
        column = lambda c: t[c].to_numpy().astype(np.int64)
        self.token, block, self.v, self.n, self.slack = (column(c) for c in ("token", "block", "v", "n", "slack"))
        self.p = turn_order(self.v, turn)
        self.blocks, self.several = column("blocks"), t["several"].to_numpy()
        self.component = column("component") if "component" in t.column_names else None
        # in blocks of two chunks, the chunk; -1 where all rows meet
        self.side = column("side") if "side" in t.column_names else None
        self.bits = _words(t["bitmap"].to_pylist())
        self.wide = WideBitmaps([w or b for w, b in zip(t["wide"].to_pylist(), t["bitmap"].to_pylist())]) if "wide" in t.column_names else None
        self.first = self.padded(t["first"]) if "first" in t.column_names else None
        new = np.concatenate([[True], (self.token[1:] != self.token[:-1]) | (block[1:] != block[:-1])])
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(new)))
        self.bucket = np.repeat(np.arange(len(self.starts)), self.sizes)
        # place of each row in the order common to all lists
        self.rank = np.empty(len(self.p), dtype=np.int64)
        self.rank[np.lexsort((self.v, self.p))] = np.arange(len(self.p))

    def left(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Which pairs of rows, x not larger than y, sizes, bitmaps and components leave."""
        limit = most_different(self.n[x], self.n[y], self.percent) + self.slack[x] + self.slack[y]
        ok = (self.percent * self.n[y] <= 100 * self.n[x]) & (apart <= limit) & (self.v[x] != self.v[y])
        if self.component is not None:
            ok &= self.component[x] != self.component[y]
        if self.side is not None:
            ok &= (self.side[x] != self.side[y]) | (self.side[x] < 0)
        if self.wide is not None:
            long = np.flatnonzero(ok & (self.wide.width[x] * 8 > BITMAP_BITS))
            ok[long] = self.wide.apart(x[long], y[long]) <= limit[long]
        return ok

    @staticmethod
    def padded(lists: pa.ChunkedArray) -> np.ndarray:
        out = np.full((len(lists), FIRST_LISTS), NO_LIST)
        size = lists.combine_chunks().value_lengths().to_numpy()
        out[np.arange(FIRST_LISTS)[None, :] < size[:, None]] = lists.combine_chunks().flatten().to_numpy()
        return out

    def owned(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that no list before this one hands on. The smallest number in both rows' first lists is the first list that
        they share; where these have none in common, each list hands the pair on."""
        if self.first is None:
            return x, y
        ok = np.empty(len(x), dtype=bool)
        for k in range(0, len(x), 10_000):
            a, b = self.first[x[k : k + 10_000]], self.first[y[k : k + 10_000]]
            shared = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, NO_LIST).min(axis=1)
            ok[k : k + 10_000] = (shared == NO_LIST) | (shared == self.token[x[k : k + 10_000]])
        return x[ok], y[ok]

    def short_pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs left in blocks of at most ``most`` rows."""
        rows = np.flatnonzero((self.sizes <= most)[self.bucket])
        found = []
        for shift in range(1, most):
            x = rows[rows + shift < len(self.v)]
            x = x[self.bucket[x] == self.bucket[x + shift]]
            for k in range(0, len(x), 100_000):
                a = x[k : k + 100_000]
                ok = self.left(a, a + shift, np.bitwise_count(self.bits[a] ^ self.bits[a + shift]).sum(axis=1, dtype=np.int64))
                found.append((a[ok], a[ok] + shift))
        none = np.empty(0, dtype=np.int64)
        return tuple(np.concatenate([none, *c]) for c in zip(*found)) if found else (none, none)

    def block_pairs(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs left in block k, some rows against all larger ones at a time."""
        first, last = self.starts[k], self.starts[k] + self.sizes[k]
        if self.side is not None and self.side[first] >= 0:
            yield from self.chunk_pairs(first, last)
            return
        step = max(1, (1 << 20) // (last - first))
        for s in range(first, last, step):
            e = min(s + step, last)
            reach = first + int(np.searchsorted(self.n[first:last], self.n[e - 1] * 100 // self.percent, side="right"))
            apart = np.zeros((e - s, reach - s), dtype=np.int16)
            for w in range(self.bits.shape[1]):
                apart += np.bitwise_count(self.bits[s:e, w][:, None] ^ self.bits[s:reach, w][None, :])
            x, y = np.nonzero((apart <= most_different(self.n[e - 1], self.n[reach - 1], self.percent) + 2 + 2 * self.slack[first:last].max()) & (np.arange(s, reach)[None, :] > np.arange(s, e)[:, None]))
            ok = self.left(x + s, y + s, apart[x, y].astype(np.int64))
            yield x[ok] + s, y[ok] + s

    def chunk_pairs(self, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs left of a block's two chunks, some rows of the one against those of the other that are near in size."""
        rows = np.arange(first, last)
        one, other = rows[self.side[first:last] == 0], rows[self.side[first:last] == 1]
        sizes, slack = self.n[other], 2 * self.slack[first:last].max()
        step = max(1, (1 << 20) // max(1, len(other)))
        for s in range(0, len(one), step):
            these = one[s : s + step]
            small, large = self.n[these[0]], self.n[these[-1]]
            near = other[np.searchsorted(sizes, small * self.percent // 100, side="left") : np.searchsorted(sizes, large * 100 // self.percent + 1, side="right")]
            if not len(near):
                continue
            apart = np.zeros((len(these), len(near)), dtype=np.int16)
            for w in range(self.bits.shape[1]):
                apart += np.bitwise_count(self.bits[these, w][:, None] ^ self.bits[near, w][None, :])
            x, y = np.nonzero(apart <= most_different(max(large, self.n[near[-1]]), max(large, self.n[near[-1]]), self.percent) + 2 + slack)
            d = apart[x, y].astype(np.int64)
            x, y = these[x], near[y]
            swap = self.n[x] > self.n[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            ok = self.left(x, y, d)
            yield x[ok], y[ok]

    def proposals(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs, for each block and lower row the pair with the highest row."""
        low, high = self.ordered(x, y)
        pick = np.lexsort((-self.rank[high], low))
        low, high = low[pick], high[pick]
        one = np.concatenate([[True], low[1:] != low[:-1]]) if len(low) else np.empty(0, dtype=bool)
        return low[one], high[one]

    def ordered(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        swap = self.rank[x] > self.rank[y]
        return np.where(swap, y, x), np.where(swap, x, y)

    def handed_on(self, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(x, y, kind) of pairs to verify (0) or proposed (1), y the higher row; (a row of it, same, 2) for each dense list.
        With ``every``, no list is dense."""
        x, y = self.owned(*self.short_pairs(32))
        many = np.bincount(self.bucket[x], minlength=len(self.starts))
        dense = (many > np.maximum(self.sizes, SPARSE)) & (not every)
        heavy = dense[self.bucket[x]]
        yield (*self.ordered(x[~heavy], y[~heavy]), 0)
        yield (*self.proposals(x[heavy], y[heavy]), 1)
        for k in np.flatnonzero(self.sizes > 32).tolist():
            held, n, most = [], 0, max(self.sizes[k], SPARSE)
            for x, y in self.block_pairs(k):
                n += len(x)
                if every:
                    yield (*self.ordered(*self.owned(x, y)), 0)
                    continue
                held.append((x, y) if n <= most else self.proposals(x, y))
            if every or not held:
                continue
            x, y = (np.concatenate(c) for c in zip(*held))
            dense[k] = n > most
            yield (*(self.proposals(x, y) if dense[k] else self.ordered(x, y)), 1 if dense[k] else 0)
        if not every:
            # blocks of a longer list were not compared with each other
            if self.component is None:
                dense |= self.blocks[self.starts] > 1
            rows = self.starts[dense]
            yield rows, rows, 2


def list_pairs(lists: DataFrame, percent: int, turn: int = 0, every: bool = False) -> DataFrame:
    """a, b, p, kind: pairs to verify (0), a's proposed partner b with its order p (1), dense list a (2). 3 is a pair to
    verify of groups, of which one has several members."""
    columns = [c for c in ("token", "block", "blocks", "v", "n", "bitmap", "slack", "several", "component", "side", "wide", "first") if c in lists.columns]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = ListRows(t, percent, turn)
            for x, y, kind in rows.handed_on(every):
                if len(x) == 0:
                    continue
                kinds = np.full(len(x), kind, dtype=np.int32)
                if kind == 0:
                    kinds[rows.several[x] | rows.several[y]] = 3
                a = rows.token[x] if kind == 2 else rows.v[x]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(rows.v[y]), pa.array(rows.p[y]), pa.array(kinds)], names=["a", "b", "p", "kind"])

        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            key = [t[c].to_numpy() for c in ("token", "block")]
            cut = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]))
            if len(cut):
                end = int(cut[-1]) + 1
                held = t.slice(end).combine_chunks().to_batches()
                yield from work(t.slice(0, end).combine_chunks())
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    dealt = lists.select(*columns).repartition("token", "block").sortWithinPartitions("token", "block", "n")
    return dealt.mapInArrow(find, "a long, b long, p long, kind int")


def chosen_pairs(found: DataFrame) -> DataFrame:
    """a, b: the pairs to verify, each once; of what a row was proposed in many lists, the highest."""
    proposed = found.where("kind = 1").groupBy("a").agg(F.max(F.struct("p", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return found.where("kind = 0").select("a", "b").unionByName(proposed).distinct()


def asked_for(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """docs, without most of those that no pair names: a Bloom filter of fixed size over the rows asked for. Where they
    are too many for it, it lets more through, and the join that follows drops the rest."""
    size = FILTER_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        for b in batches:
            for i in (0, 1):
                bits[(mix(b.column(i).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(size)).astype(np.int64)] = True
        words = np.packbits(bits).view(np.uint64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["word", "bits"])

    marks = pairs.select("ra", "rb").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, dtype=np.int64)
    words[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    @F.pandas_udf(BooleanType())
    def asked(rows: pd.Series) -> pd.Series:
        at = (mix(rows.to_numpy(dtype=np.int64).view(np.uint64)) % np.uint64(size)).astype(np.int64)
        return pd.Series((shared.value.view(np.uint8)[at // 8] >> (7 - at % 8).astype(np.uint8)) & 1 == 1)

    return docs.where(asked("row"))


def possible_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b plus the key and digest of a row of both classes, where the wide bitmaps leave a link open."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in (8, 9))
            apart = np.zeros(b.num_rows, dtype=np.int64)
            wa, wb = (b.column(i).to_pylist() for i in (10, 11))
            long = [i for i in range(b.num_rows) if wa[i] is not None and wb[i] is not None]
            if long:
                at = np.arange(len(long))
                apart[long] = WideBitmaps([wa[i] for i in long] + [wb[i] for i in long]).apart(at, at + len(long))
            ok = pa.array((apart <= most_different(na, nb, percent)) & (percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in range(8)], names=b.schema.names[:8])

    pairs = kept(pairs, "candidates")
    facts = facts_of(classes, pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))))
    side = lambda p: facts.select(F.col("v").alias(p), F.col("row").alias(f"r{p}"), F.col("d1").alias(f"d{p}"), F.col("d2").alias(f"e{p}"), F.col("n").alias(f"n{p}"), F.col("wide").alias(f"w{p}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "da", "ea", "db", "eb", "na", "nb", "wa", "wb")
    return rows.mapInArrow(check, "a long, b long, ra long, rb long, da long, ea long, db long, eb long")


_UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def word_shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    """The set of a text's shingles as words, without any hash."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UPPER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b of the pairs whose whole texts link. Sets are compared by hashes, and those that agree once more by words.

    The text of b is sent once for HUB_ROWS partners, not with each pair; that of a once a pair."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by b and salt, the text of b before those of its partners
        hub, hub_text, hub_set = None, None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                b, salt, a, ea, eb, da, db, texts = (c.to_pylist() for c in part.columns)
                linked = []
                for i, s in enumerate(shingle_sets(texts, width)):
                    if a[i] is None:
                        # keys of rows may be equal by chance: only the text that was looked up counts
                        if digest(s) == (db[i], eb[i]):
                            hub, hub_text, hub_set = (b[i], salt[i]), texts[i], s
                        continue
                    if hub != (b[i], salt[i]) or digest(s) != (da[i], ea[i]):
                        continue
                    both = len(np.intersect1d(s, hub_set, assume_unique=True))
                    if (100 + percent) * both >= percent * (len(s) + len(hub_set)):
                        x, y = word_shingles(texts[i], width), word_shingles(hub_text, width)
                        if 100 * len(x & y) >= percent * len(x | y):
                            linked.append((a[i], b[i]))
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*linked)], names=["a", "b"])

    # a row that stands many times is looked up once
    docs = asked_for(docs.select("row", "text"), pairs).repartition("row").dropDuplicates(["row", "text"])
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts"))
    none = F.lit(None).cast("long")
    partners = pairs.join(salts, "b").select("b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), "a", "ea", none.alias("eb"), "da", none.alias("db"), F.col("ra").alias("row"))
    hubs = pairs.groupBy("b").agg(F.first("rb").alias("row"), F.first("db").alias("db"), F.first("eb").alias("eb")).join(salts, "b")
    hubs = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), none.alias("a"), none.alias("ea"), "eb", none.alias("da"), "db", "row")
    rows = partners.unionByName(hubs).join(docs, "row").select("b", "salt", "a", "ea", "eb", "da", "db", "text")
    dealt = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(check, "a long, b long").distinct()


def link_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """id, component of every class that links to another."""

    def checked(found: DataFrame) -> DataFrame:
        pairs = kept(possible_pairs(chosen_pairs(found), classes, percent), "pairs")
        return kept(verify(docs, pairs, width, percent), "links")

    def single(columns: str) -> DataFrame:
        return found.where(columns).select(F.col("a").alias("token")).distinct()

    groups, members = groups_of(classes)
    found = kept(list_pairs(group_lists(groups), percent), "found")
    labels = component_labels(checked(found))
    # groups left in pairs, and lists that are not done, are expanded to their members
    led = members.select("v", F.col("leader").alias("g"))
    wider = lambda rows: rows.join(led, "g", "left").select("token", F.coalesce(led["v"], "g").alias("v"))
    listed = groups.select(F.col("v").alias("g"), F.explode("prefix").alias("token")).join(single("kind = 2"), "token")
    mixed = found.where("kind = 3").select("a", "b").distinct()
    mixed = mixed.select(F.xxhash64(F.lit("pair"), "a", "b").alias("token"), F.explode(F.array("a", "b")).alias("g"))
    alone = members.select(F.xxhash64(F.lit("group"), "leader").alias("token"), "v")
    lists = kept(wider(listed).unionByName(wider(mixed)).unionByName(alone), "lists")
    for turn in range(1, TURNS + 2):
        if lists.isEmpty():
            break
        found = kept(list_pairs(member_lists(lists, labels, classes, turn > TURNS), percent, turn, turn > TURNS), "found")
        # labels name the links found so far as stars
        links = labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(checked(found))
        labels = component_labels(links)
        lists = kept(lists.join(single("kind = 2"), "token", "left_semi"), "lists")
    return labels


def link_components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of docs(doc_id, text): linked are sets of ``width``-word shingles whose Jaccard
    similarity is at least ``similarity``."""
    percent = percent_of(similarity)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    sketched = kept(sketches(docs, frequent_shingles(docs, width, percent), width, percent), "sketches")
    classes = kept(grouped_classes(sketched), "classes")
    labels = link_classes(docs, classes, width, percent)
    vertices = classes.select("d1", "d2", "v").join(labels.withColumnRenamed("id", "v"), "v", "left").select("d1", "d2", F.coalesce("component", "v").alias("label"))
    lowest = sketched.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("low")).join(vertices, ["d1", "d2"])
    named = lowest.join(lowest.groupBy("label").agg(F.min("low").alias("component_id")), "label").select("d1", "d2", "component_id")
    whole = sketched.where("n > 0").select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "n", "component_id")
    alone = sketched.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
