"""9. Benchmark decontamination: size-partitioned MinHash containment search (DataFrame functions only).

Short test items are searched inside long documents. An item is found where a document holds at least ``share`` of its
distinct five-word shingles. Items are partitioned by size (powers of two of their shingle count). Of m shingles, at
most m - ceil(share x m) may be missing, so an item's sketch is its m - ceil(share x m) + 1 smallest hashes: a document
that contains the item must hold one of them. Each partition has a limit, its largest sketch hash. A document probes only
the partitions whose smallest item it has shingles enough to contain, and with no hash beyond the limits of these, so
short documents leave the partitions of long items alone and long ones give up most shingles before the lookup. All
widths and partitions are probed in one reading of the documents. Candidates are verified by exact shingle containment,
so no containing pair is missed and none is wrong.

Cases: null and empty texts match nothing; items without words match nothing; items of fewer than five words are one
shingle of their own width; rows of one item_id are one item and rows of one doc_id one document, as in the SQL; rows
without an id are told apart by their texts, each text an item or document of its own with a null id in the result.
Repeated document rows give one result a doc_id and item. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlake.llm.common import checkpointed
from flowlake.llm.shingles import let, letter_words, shingle_hashes

WIDTH = 5
SHARE = 0.8
#: Up to these many rows a small side is sent to all tasks; beyond, Spark deals both sides by the key.
BROADCAST_ROWS = 2_000_000
CANDIDATE_BROADCAST_ROWS = 500_000


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def keys(name: str) -> tuple[Column, Column]:
    """What names a row wherever ids may be null: the id, or a hash of the text where there is none; and whether so."""
    own = F.col(name).cast("long")
    return F.coalesce(own, F.xxhash64("text")), own.isNull()


def keyed(rows: DataFrame, name: str, flag: str) -> DataFrame:
    key, missing = keys(name)
    return rows.select(key.alias(name), missing.alias(flag), "text")


DOC, ITEM = ["doc_id", "no_doc_id"], ["item_id", "no_item_id"]


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """item_id, no_item_id, width, n (distinct shingles of the item), h, rank of h among the item's hashes."""
    words = benchmark.select(*ITEM, letter_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(WIDTH))
    per_width = F.lit(None).cast("array<bigint>")
    for n in range(1, WIDTH + 1):
        per_width = F.when(width == n, shingle_hashes(F.col("w"), n)).otherwise(per_width)
    rows = words.select(*ITEM, width.alias("width"), per_width.alias("h"))
    rows = rows.select(*ITEM, "width", F.explode("h").alias("h")).dropDuplicates([*ITEM, "width", "h"])
    n = F.count("*").over(Window.partitionBy(*ITEM, "width"))
    rank = F.row_number().over(Window.partitionBy(*ITEM, "width").orderBy("h"))
    return rows.select(*ITEM, "width", n.alias("n"), "h", rank.alias("rank"))


def needed(n: Column) -> Column:
    """ceil(SHARE x n), in whole numbers."""
    return F.floor((n * int(SHARE * 100) + 99) / 100)


def reached(n: Column, parts: list[tuple[int, int]]) -> tuple[Column, Column]:
    """For a document of n shingles and (part, limit) of the partitions: the last partition it can probe (-1: none) and
    the largest limit up to there."""
    part, limit, most = F.lit(-1), F.lit(-(2**63)).cast("long"), -(2**63)
    for p, own in sorted(parts):
        most = max(most, own)
        able = n >= needed(F.lit(1 << p))
        part, limit = F.when(able, F.lit(p)).otherwise(part), F.when(able, F.lit(most)).otherwise(limit)
    return part, limit


def document_hashes(docs: DataFrame, widths: list[int], limits: dict[int, list[tuple[int, int]]] | None = None) -> DataFrame:
    """DOC, width, h, reach of the documents' distinct shingles, all widths in one reading; with ``limits``, (part, limit)
    for each width, only of hashes that a partition within reach may hold."""

    def of(width: int):
        row = lambda x, reach: F.struct(F.lit(width).alias("width"), reach.alias("reach"), x.alias("h"))

        def hashes(h: Column) -> Column:
            if not limits:
                return F.transform(h, lambda x: row(x, F.lit(None).cast("int")))
            reach, limit = reached(F.size(h), limits[width])
            # both once a document, not once a hash
            return let(F.struct(reach.alias("reach"), limit.alias("limit")), lambda r: F.transform(F.filter(h, lambda x: x <= r["limit"]), lambda x: row(x, r["reach"])))

        return hashes

    words = docs.select(*DOC, letter_words(F.col("text")).alias("w"))
    each = [let(shingle_hashes(F.col("w"), width), of(width)) for width in widths]
    return words.select(*DOC, F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("s")).select(*DOC, "s.width", "s.h", "s.reach")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, n_shingles, containment of every pair with containment of at least SHARE."""
    found = containing(docs, benchmark)
    shown = lambda name: F.when(~F.col(f"no_{name}"), F.col(name)).alias(name)
    return found.select(shown("doc_id"), shown("item_id"), "matched", "n_shingles", "containment")


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that contain an item, rows without a doc_id included."""
    found = containing(docs, benchmark).select(F.col("doc_id").alias("_found"), F.col("no_doc_id").alias("_found_no")).distinct()
    key, missing = keys("doc_id")
    return docs.join(found, (key == F.col("_found")) & (missing == F.col("_found_no")), "left_anti")


def containing(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What contaminated() gives, by the keys DOC and ITEM."""
    docs = keyed(docs, *DOC)
    items = checkpointed(item_shingles(keyed(benchmark, *ITEM)))
    sketches, limits, rows = partitions(items)
    if not limits:
        return items.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("no_doc_id"), *ITEM, F.lit(0).cast("long").alias("matched"), F.col("n").cast("long").alias("n_shingles"), F.lit(0.0).alias("containment")).limit(0)
    probe = _small(sketches.select(*ITEM, "width", "part", "h"), rows, BROADCAST_ROWS)
    found = document_hashes(docs, sorted(limits), limits).join(probe, ["width", "h"]).where("part <= reach")
    candidates = checkpointed(found.select(*DOC, *ITEM, "width").distinct())
    return verify(docs, items, candidates)


def partitions(items: DataFrame) -> tuple[DataFrame, dict[int, list[tuple[int, int]]], int]:
    """The items' sketches with their partition, (part, limit) of the partitions of each width, and the sketches' rows."""
    sketches = items.where(F.col("rank") <= F.col("n") - needed(F.col("n")) + 1).withColumn("part", F.floor(F.log2("n")).cast("int"))
    limits: dict[int, list[tuple[int, int]]] = {}
    rows = 0
    # a row for each width and power of two
    for r in sketches.groupBy("width", "part").agg(F.max("h").alias("limit"), F.count("*").alias("rows")).collect():
        limits.setdefault(r["width"], []).append((r["part"], r["limit"]))
        rows += r["rows"]
    return sketches, limits, rows


def verify(docs: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Exact shingle containment of candidates(DOC, ITEM, width)."""
    ids = candidates.select(*DOC).distinct()
    wanted = candidates.select(*ITEM, "width").distinct()
    own = docs.join(_small(ids, ids.count(), CANDIDATE_BROADCAST_ROWS), DOC, "left_semi")
    shingles = items.join(wanted, [*ITEM, "width"], "left_semi").select(*ITEM, "width", "n", "h")
    widths = sorted(r["width"] for r in candidates.select("width").distinct().collect()) or [WIDTH]
    hits = document_hashes(own, widths).select(*DOC, "width", "h").join(_small(shingles, items.count(), BROADCAST_ROWS), ["width", "h"]).distinct()
    counts = hits.groupBy(*DOC, *ITEM, "width", "n").agg(F.count("*").alias("matched"))
    whole = counts.where(F.col("matched") >= needed(F.col("n"))).join(candidates, [*DOC, *ITEM, "width"], "left_semi")
    return whole.select(*DOC, *ITEM, F.col("matched").cast("long"), F.col("n").cast("long").alias("n_shingles"), (F.col("matched") / F.col("n")).alias("containment"))
