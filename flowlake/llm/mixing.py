"""11. Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated up to ``most_repeats`` times. A copy's virtual finish
time is the number of its source's words up to and with it, over the source's target. All copies are sorted by it in one
range-partitioned sort, and the order is cut where the words so far reach the budget; so at any place of the order the
sources stand near their weights, and at the cut near their targets. Documents are taken whole.

Targets: weights share the budget (all words); a target above ``most_repeats`` times its source is cut to that, and what is
left over is shared again by weight among the others, until none is above.

Scale: rows are counted by (source, doc_id, size) before anything is sorted, so repeated rows cost one row, and texts never
leave the scan. A source's words are added up in parts, cut by the shuffle key, with the parts' totals in front: a source
with a third of all rows is spread over all parts. What the driver holds is one row a source (at most SOURCES, else it
raises: each is a configured weight), one total a range of the sort, and the cut itself.

Cases: null and empty texts have 0 words and take part with 0 taken; null sources are one source, the last; null doc_ids
and rows repeated stand for themselves (such rows of one size are told apart by number only); a source without words has
target 0; ties in finish time go by the shuffle key; an empty table gives no rows; other input columns do not matter and
are not returned. The shuffle key is a hash of doc_id, so reruns agree whatever the partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlake.llm.common import kept

#: Sources at most; rows a part of a source's queue or a range of the sort holds about.
SOURCES, PART_ROWS = 100_000, 100_000
WEIGHTS = (1, 2, 3)
_KEY_BITS = 60
#: The order of copies: finish time first, the rest only where these are equal.
ORDER = ("finish", "key", "doc_id", "size", "queue", "number", "repeat")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def share(sizes: list[int], weights: list[int], most_repeats: int) -> list[float]:
    """The target of each source."""
    targets: list[Fraction | None] = [None] * len(sizes)
    left, open_ = Fraction(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > most_repeats * sizes[i]]
        for i in above or open_:
            targets[i] = Fraction(most_repeats * sizes[i]) if above else unit * weights[i]
        if not above:
            break
        left -= sum(targets[i] for i in above)
        open_ -= set(above)
    return [float(t) for t in targets]


@dataclass
class Queues:
    """items: one row for each (source, doc_id, size), with the words in front of it in its queue."""

    items: DataFrame
    budget: int
    rows: int
    most_repeats: int


def queues(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3) -> Queues:
    spark = docs.sparkSession
    counted = docs.select("source", "doc_id", words(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))
    counted = kept(counted, "mix-rows")
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.sum("rows").alias("rows")).limit(SOURCES + 1).collect()
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources, each of which needs a weight")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in totals]
    targets = share(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most_repeats)
    rows = sum(r["rows"] for r in totals)
    kind = dict(docs.dtypes)["source"]
    table = spark.createDataFrame([(r["source"], i, s, t) for i, (r, s, t) in enumerate(zip(totals, sizes, targets))], f"_source {kind}, queue int, source_size long, target double")
    parts = max(16, -(-rows // PART_ROWS))
    keyed = counted.withColumn("key", shuffle_key(F.col("doc_id")))
    keyed = keyed.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("part", (F.col("key") / F.lit(float(2**_KEY_BITS)) * parts).cast("int"))
    own = F.col("size") * F.col("rows")
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("queue", "part").agg(F.sum(own).alias("own")).select("queue", "part", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("queue", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    items = keyed.withColumn("inside", F.coalesce(F.sum(own).over(inside), F.lit(0))).join(bases, ["queue", "part"])
    items = items.select("source", "doc_id", "size", "rows", "queue", "source_size", "target", "key", (F.col("base") + F.col("inside")).alias("before"))
    return Queues(kept(items, "mix-queues"), sum(sizes), rows, most_repeats)


def finish(repeat: Column, number: Column) -> Column:
    """Virtual finish time of a copy: words of its queue up to and with it, over the queue's target."""
    return F.try_divide((repeat * F.col("source_size") + F.col("before") + number * F.col("size")).cast("double"), F.col("target"))


def ordered(q: Queues) -> DataFrame:
    """All copies of documents with words, sorted by finish time over the ranges 0, 1, ... of column ``range``."""
    copies = q.items.where("size > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("number"))
    copies = copies.select("*", F.explode(F.sequence(F.lit(0), F.lit(q.most_repeats - 1))).alias("repeat"))
    copies = copies.withColumn("finish", finish(F.col("repeat"), F.col("number"))).select(*ORDER)
    ranges = max(8, -(-q.rows * q.most_repeats // PART_ROWS))
    sorted_ = copies.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER)
    return kept(sorted_.withColumn("range", F.spark_partition_id()), "mix-order")


def last_taken(copies: DataFrame, budget: int) -> dict | None:
    """The last copy of the order with which the words so far are within the budget; None where none is."""
    sums = {r["range"]: r["words"] for r in copies.groupBy("range").agg(F.sum("size").alias("words")).collect()}
    so_far, last = 0, None
    for k in sorted(sums):
        if so_far + sums[k] > budget:
            upto = F.sum("size").over(Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
            inside = copies.where(F.col("range") == k).withColumn("upto", upto).where(F.col("upto") <= budget - so_far)
            cut = inside.orderBy(*(F.col(c).desc() for c in ORDER)).select(*ORDER).first()
            return cut.asDict() if cut is not None else last and _last_of(copies, last[0])
        so_far, last = so_far + sums[k], (k,)
    return last and _last_of(copies, last[0])


def _last_of(copies: DataFrame, k: int) -> dict:
    return copies.where(F.col("range") == k).orderBy(*(F.col(c).desc() for c in ORDER)).select(*ORDER).first().asDict()


def _upto(values: dict[str, Column], cut: dict) -> Column:
    """Whether the copy with these values stands at or before the cut."""
    out = F.lit(True)
    for c in reversed(ORDER):
        v = values[c]
        if c == "doc_id":  # nulls stand first
            at = cut[c]
            less = v.isNull() & F.lit(at is not None) if at is None else v.isNull() | (v < F.lit(at))
            same = v.eqNullSafe(F.lit(at))
        else:
            less, same = v < F.lit(cut[c]), v == F.lit(cut[c])
        out = less | (same & out)
    return F.coalesce(out, F.lit(False))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """One row per document of docs(doc_id, text, source): doc_id, source, size, source_size, target, copies, taken."""
    q = queues(docs, weights, most_repeats)
    cut = last_taken(ordered(q), q.budget)
    rows = q.items.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("number"))
    copies = F.lit(0)
    if cut is not None:
        for repeat in range(most_repeats):
            values = {c: F.col(c) for c in ORDER if c not in ("finish", "repeat")} | {"finish": finish(F.lit(repeat), F.col("number")), "repeat": F.lit(repeat)}
            copies = copies + F.when((F.col("size") > 0) & _upto(values, cut), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies").cast("long") * F.col("size"))


def mixed_order(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """The mix itself: (doc_id, repeat, finish, range) of every copy taken, in ranges of ascending finish time."""
    q = queues(docs, weights, most_repeats)
    copies = ordered(q)
    cut = last_taken(copies, q.budget)
    taken = copies.where(_upto({c: F.col(c) for c in ORDER}, cut)) if cut is not None else copies.limit(0)
    return taken.select("doc_id", "number", "repeat", "size", "finish", "range")
