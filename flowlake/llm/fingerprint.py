"""2. Document fingerprints: bottom-k sketch of shingle hashes (DataFrame functions only).

A sketch is the ascending array of the k smallest distinct hashes of a text's five-word shingles. Sketches of parts
merge into the sketch of the whole; two sketches estimate resemblance, containment and the number of distinct shingles.

Cases: null text is an empty text, whose sketch is empty; fewer than five words are one shingle; two empty sketches are
alike (1.0), an empty and another are not (0.0); equal texts have equal sketches; equal doc_ids follow each other by
text; rows with a null doc_id come first; a table of one row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlake.llm.common import text_bytes
from flowlake.llm.shingles import blank_words, let, shingle_hashes

SKETCH_SIZE = 128
#: Text that a task deals with when documents meet the next ones, about; tasks at most; and ranges of doc_id a task.
TASK_BYTES, MOST_TASKS, RANGES = 64 << 20, 8_000, 4


def bottom_k(hashes: Column, k: int = SKETCH_SIZE) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = SKETCH_SIZE) -> Column:
    return bottom_k(shingle_hashes(blank_words(text)), k)


def merge(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of two parts together."""
    return bottom_k(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes that both have."""

    def share(both: Column) -> Column:
        shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared.cast("double") / F.size(both))

    return let(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def share_within(j: Column, a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of a's shingles that b has, where their resemblance j is known."""
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of a's shingles that b has."""
    return share_within(resemblance(a, b, k), a, b, k)


def merge_parts(parts: DataFrame, key: str, column: str, k: int = SKETCH_SIZE) -> DataFrame:
    """One sketch for each key from the sketches of its parts. A part's rows shrink to k hashes a task before they
    are dealt, whatever the number of parts of a key."""
    hashes = parts.select(key, F.explode(column).alias("_h")).distinct()
    ranked = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(column))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def place_among(starts: list[int], value: Column) -> Column:
    """How many of the ascending starts are at or below the value: first of their blocks, then within one block."""
    step = max(1, int(len(starts) ** 0.5))
    blocks = [starts[i : i + step] for i in range(0, len(starts), step)]
    of = lambda numbers: F.array(*(F.lit(s) for s in numbers))
    count = lambda numbers: F.size(F.filter(numbers, lambda s: s <= value))
    inner = F.array(*(of(b) for b in blocks))
    return let(count(of([b[0] for b in blocks])), lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * step + count(F.element_at(inner, k))))


def with_next(docs: DataFrame, partitions: int | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text and, from the next document by doc_id (after the last: the first), next_text.

    ``extra`` names columns of the document that are wanted of the next one too. Documents are dealt once, by ranges of
    doc_id between quantiles, of which there are more the more text there is; the first document of a range is the one
    whose id is the quantile, so the seams between ranges need only these few rows.
    """
    spark = docs.sparkSession
    extra = extra or {}
    low = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions or min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(rows) // TASK_BYTES))
    # several ranges a task, so that tasks that are dealt more of them than others matter little
    ranges = n * RANGES
    cuts = rows.agg(F.min("_id"), F.percentile_approx("_id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()
    starts = sorted({cuts[0], *(cuts[1] or [])} - {None}) or [0]
    rows = rows.withColumn("_range", place_among(starts, F.col("_id")))
    firsts = (
        rows.where(F.col("_id").isin(starts))
        .groupBy("_range")
        .agg(F.min(F.struct("_id", "text")).alias("_f"))
        .select(F.when(F.col("_range") == 1, F.lit(len(starts))).otherwise(F.col("_range") - 1).alias("_range"), F.col("_f.text").alias("text"))
        .select("_range", F.struct("text", *(c.alias(k) for k, c in extra.items())).alias("_seam"))
    )
    w = Window.partitionBy("_range").orderBy("_id", "text")
    rows = rows.select("_range", "_id", "doc_id", "text", *(c.alias(k) for k, c in extra.items()))
    rows = rows.repartition(n, "_range").withColumn("_next", F.lead(F.struct("text", *extra)).over(w)).join(firsts, "_range", "left")
    nxt = F.coalesce("_next", "_seam")
    return rows.select("doc_id", "text", *extra, nxt["text"].alias("next_text"), *(nxt[k].alias(f"next_{k}") for k in extra))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and estimated from the
    sketches: distinct_shingles of the text, within_edited and within_next (the shares of its shingles that the edited
    text and the next document have).

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) first ones of the next
    document.
    """
    pairs = with_next(docs, extra={"sketch": sketch(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    own, new, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    rows = rows.withColumns({"near_edited": resemblance(own, new), "near_next": resemblance(own, following)})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(own).alias("fingerprint"),
        as_text(new).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        distinct_shingles(own).alias("distinct_shingles"),
        share_within(F.col("near_edited"), own, new).alias("within_edited"),
        share_within(F.col("near_next"), own, following).alias("within_next"),
    )
