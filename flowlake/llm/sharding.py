"""4. Sharding by histogram sort (DataFrame functions only), law ``bytes``: shards of nearly equal size.

Documents are ordered by (hash of the text, doc_id), so equal texts stand together and are cut apart only where a shard
border runs through a group. Each round counts exact bytes between candidate borders over all rows and keeps, for each
border, the one cell that holds its target, until every border is within tolerance or inside the rows of a single key.
Then the documents are exchanged once.

Rows of one key (repeated rows) that a border cuts, or that are too many for one task, are numbered first, in parts, from
exact counts; a border is then a key and a place among its rows.

Cases: null text counts 16 bytes; null doc_id orders first; empty table: no rows; repeated rows are placed one by one, in
no fixed order among themselves, and borders cut them like any others; a document larger than a shard makes its shard
larger; input columns named shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType
from pyspark.sql.window import Window

from flowlake.llm.common import checkpointed, free_name, kept

ROW_BYTES = 16
#: A key with more rows than this, and than four times a part's share, is numbered in parts of its own.
HOT_ROWS = 10_000
_KEY = DecimalType(38, 0)
_TWO64 = 2**64


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def order_key(text: Column, doc_id: Column) -> Column:
    """126 bits: 62 of the text's hash, then doc_id."""
    high = F.shiftrightunsigned(F.xxhash64(text), 2).cast(DecimalType(20, 0))
    low = F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).cast(DecimalType(20, 0)) + F.lit(str(2**63)).cast(DecimalType(20, 0))
    return (high * F.lit(str(_TWO64)).cast(DecimalType(20, 0)) + low).cast(_KEY)


def _number(n: int) -> Column:
    return F.lit(str(n)).cast(_KEY)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.0005, cells: int = 512) -> list[tuple[int, int]]:
    """The first (key, place among the rows of this key) of each shard but the first, from keys(key, size). The driver
    holds (shards x cells) counts."""
    total, low, high = keys.agg(F.sum("size"), F.min("key"), F.max("key")).first()
    if total is None:
        return []
    targets = {i: total * i // shards for i in range(1, shards)}
    slack = total * tolerance / shards
    found: dict[int, tuple[int, int]] = {}
    # border -> (first key, last key, bytes before the first key) of the range that holds its target
    spans = {i: (int(low), int(high), 0) for i in targets}
    while spans:
        ranges = sorted({(lo, hi, before) for lo, hi, before in spans.values()})
        which = F.lit(None).cast("int")
        cell = F.lit(None).cast("long")
        for k, (lo, hi, _) in enumerate(ranges):
            width = max(1, -(-(hi - lo + 1) // cells))
            inside = (F.col("key") >= _number(lo)) & (F.col("key") <= _number(hi))
            which = F.when(inside, F.lit(k)).otherwise(which)
            # decimal division by a whole width; a row's cell needs to be the same each time, not exact at the edges
            cell = F.when(inside, F.expr(f"(key - cast('{lo}' as decimal(38,0))) div cast('{width}' as decimal(38,0))").cast("long")).otherwise(cell)
        counted = keys.select(which.alias("which"), cell.alias("cell"), "key", "size").where("which is not null")
        counts = counted.groupBy("which", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        by_range: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["which"], r["cell"])):
            by_range.setdefault(r["which"], []).append(r)
        place = {span: k for k, span in enumerate(ranges)}
        for i, span in list(spans.items()):
            before, rows = span[2], by_range[place[span]]
            for j, r in enumerate(rows):
                after = before + r["bytes"]
                if after >= targets[i] or j == len(rows) - 1:
                    up, down = after - targets[i], targets[i] - before
                    above = int(rows[j + 1]["lo"]) if j + 1 < len(rows) else span[1] + 1
                    if r["lo"] == r["hi"]:
                        # rows of one key have one size
                        own = round(down * r["rows"] / r["bytes"])
                        found[i] = (int(r["lo"]), own) if own < r["rows"] else (above, 0)
                        del spans[i]
                    elif min(up, down) <= slack:
                        found[i] = (int(r["lo"]) if down <= up else above, 0)
                        del spans[i]
                    else:
                        spans[i] = (int(r["lo"]), int(r["hi"]), before)
                    break
                before = after
    return [found[i] for i in sorted(found)]


def shard_number(key: Column, splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the key (place 0 of it), found by halving."""

    def within(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        at, place = splitters[middle]
        below = key <= _number(at) if place else key < _number(at)
        return F.when(below, within(first, middle)).otherwise(within(middle + 1, last))

    return within(0, len(splitters))


def hot_keys(keys: DataFrame, splitters: list[tuple[int, int]], least: int) -> dict[int, int]:
    """Rows of each key that a border cuts or that has more than ``least``."""
    counts = keys.groupBy("key").agg(F.count("*").alias("rows"))
    cut = sorted({k for k, place in splitters if place})
    wanted = F.col("rows") > least
    if cut:
        wanted |= F.col("key").isin([_number(k) for k in cut])
    return {int(r["key"]): r["rows"] for r in counts.where(wanted).collect()}


def hot_places(hot: dict[int, int], splitters: list[tuple[int, int]], rows_of: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(key, first place, place behind the last, shard, slot of the first) of every stretch of a hot key in one shard;
    their slots follow those of the shard's other rows, of which there are ``rows_of``."""
    ends, out = dict(rows_of), []
    for key in sorted(hot):
        cuts = [place for k, place in splitters if k == key and place]
        shard = sum(1 for k, place in splitters if (k, place) <= (key, 0))
        bounds = [0, *cuts, hot[key]]
        for n, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if hi > lo:
                first = ends.get(shard + n, 0)
                out.append((key, lo, hi, shard + n, first))
                ends[shard + n] = first + hi - lo
    return out


def shard(docs: DataFrame, shards: int = 40, spread: int = 256) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (0, 1, ... within the shard) to docs(doc_id, text, ...).

    A shard's rows are numbered in ``spread`` parts at once: a part begins where the parts before it end, known from
    shards x spread exact counts.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    key, part, base, of, in_part, ahead, lo, hi, first = (free_name(docs, f"_{n}") for n in ("key", "part", "base", "of", "in_part", "ahead", "lo", "hi", "first"))
    order = order_key(F.col("text").cast("string"), F.col("doc_id"))
    keys = checkpointed(docs.select(order.alias("key"), size_of(F.col("text").cast("string")).alias("size")))
    splitters = find_splitters(keys, shards)
    hot = hot_keys(keys, splitters, max(HOT_ROWS, 4 * keys.count() // (shards * spread)))
    # at most 2 x shards x spread keys, in practice none
    in_hot = lambda c: c.isin([_number(k) for k in hot]) if hot else F.lit(False)
    number = shard_number(F.col("key"), splitters)
    parts = F.pmod(F.xxhash64("key"), F.lit(spread)).cast("int")
    counts = keys.where(~in_hot(F.col("key"))).groupBy(number.alias("shard"), parts.alias(part)).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("shard", part, F.coalesce(before, F.lit(0)).alias(base))  # at most shards x spread rows
    every = docs.withColumn(key, order)
    rows = every.where(~in_hot(F.col(key)))
    rows = rows.withColumn("shard", shard_number(F.col(key), splitters)).withColumn(part, F.pmod(F.xxhash64(key), F.lit(spread)).cast("int"))
    rows = rows.withColumn("slot", F.row_number().over(Window.partitionBy("shard", part).orderBy(key)).cast("long") - 1)
    rows = rows.join(F.broadcast(bases), ["shard", part])
    placed = rows.withColumn("slot", F.col("slot") + F.col(base)).select(*docs.columns, "shard", "slot")
    if not hot:
        return placed
    # hot rows are kept with a part drawn for each, so both steps see the same parts
    drawn = kept(every.where(in_hot(F.col(key))).withColumn(base, F.monotonically_increasing_id()).withColumn(part, F.pmod(F.xxhash64(base), F.lit(spread)).cast("int")), "hot")
    counts = drawn.groupBy(key, part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col(key).alias(of), F.col(part).alias(in_part), F.coalesce(before, F.lit(0)).alias(ahead))
    place = F.row_number().over(Window.partitionBy(key, part).orderBy(base)).cast("long") - 1
    rows = drawn.withColumn("slot", place).join(bases, (F.col(key) == F.col(of)) & (F.col(part) == F.col(in_part)))
    rows = rows.withColumn("slot", F.col("slot") + F.col(ahead)).drop(of, in_part, ahead)
    rows_of = {r["shard"]: r["n"] for r in keys.where(~in_hot(F.col("key"))).groupBy(number.alias("shard")).agg(F.count("*").alias("n")).collect()}
    stretches = spark.createDataFrame([(str(k), *r) for k, *r in hot_places(hot, splitters, rows_of)], f"{of} string, {lo} long, {hi} long, shard int, {first} long")
    stretches = F.broadcast(stretches.withColumn(of, F.col(of).cast(_KEY)))
    rows = rows.join(stretches, (F.col(key) == F.col(of)) & (F.col("slot") >= F.col(lo)) & (F.col("slot") < F.col(hi)))
    return placed.unionByName(rows.withColumn("slot", F.col(first) + F.col("slot") - F.col(lo)).select(*docs.columns, "shard", "slot"))
