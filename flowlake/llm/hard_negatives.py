"""12. Hard-negative mining: for each anchor, near rows of other labels within windows below its positives' scores.

Candidates are cut into cells around pivots (the top of a cover tree, fitted on at most PIVOT_ROWS rows; every row is
indexed), and cells into parts of at most about PART_ROWS rows by a hash of vec_id; each part becomes a forest of cover trees
(`cover_tree.py`), written to the shared folder in pieces. Anchors meet the parts in a stream: a task loads a part's forest,
then takes anchors batch by batch, so its memory is one forest and one batch, whatever the number of anchors. Beyond LANE
anchors a part's forest is read by several tasks.

First each anchor's positives are found (same label, first k by score), then all windows of an anchor in one descent a
part; an anchor goes only to cells whose bounds meet one of its windows. Each task returns the first k a window, from which
the first k of all are taken; nothing is approximate.

Cases: null vec_ids, labels and vectors and null or non-finite components take no part; shorter vectors, empty ones
included, count as ending in zeros; repeated vec_ids are candidates each, but no positives of an anchor of this vec_id; where
several rows have an anchor's vec_id, the one with the smallest (label, vector) is the anchor; anchors with negative
positive scores have empty windows; ties go by smaller vec_id; an empty table gives no rows; other input columns do not
matter and are not returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlake.llm.common import kept
from flowlake.llm.cover_tree import Forest, augmented, build
from flowlake.llm.vectors import floored, matrix, usable

#: Rows of a part, anchors that one reading of a part's forest serves, and bytes of a piece of a forest.
PART_ROWS, LANE, PIECE = 4096, 65_536, 1 << 20
#: Rows that pivots are chosen from, and pivots at most.
PIVOT_ROWS, PIVOTS = 8192, 256
_STREAM = "part int, lane int, kind int, seq int, data binary, anchor_id long, label long, v array<long>, lows array<long>, highs array<long>"
_FOUND = "anchor_id long, window int, score long, vec_id long"


def prepare(vectors: DataFrame, label: Column, scale: int) -> tuple[DataFrame, int, int]:
    """(vec_id, label, v) of the rows that take part, as integers; their number and the vectors' length."""
    good = vectors.select("vec_id", label.cast("long").alias("label"), "embedding")
    good = good.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    n, longest = good.agg(F.count("*"), F.max(F.size("embedding"))).first()
    length = max(longest or 0, 1)
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), "label", floored(F.col("embedding"), scale, length).alias("v"))
    return kept(rows.repartition(-(-n // PART_ROWS) or 1), "candidates"), n, length


def pivots(rows: DataFrame, number: int, length: int) -> np.ndarray:
    """Up to ``number`` rows that lie far apart, each the farthest from those before it, out of a bounded sample."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_ROWS).select("v").collect()
    v = np.array([r["v"] for r in sample], dtype=np.int64).reshape(len(sample), length)
    chosen = [0]
    d = ((v.astype(np.float64) - v[0]) ** 2).sum(axis=1)
    while len(chosen) < number and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((v.astype(np.float64) - v[chosen[-1]]) ** 2).sum(axis=1))
    return v[chosen]


class Index:
    """Forests of all parts in the shared folder, and what the driver knows of them: one line a cell."""

    def __init__(self, rows: DataFrame, n: int, length: int):
        self.length = length
        self.most = int(rows.agg(F.max(F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)")))).first()[0])
        self.pivots = pivots(rows, min(PIVOTS, -(-n // PART_ROWS)), length)
        celled = kept(rows.mapInArrow(_cells(self.pivots, self.most), "vec_id long, label long, v array<long>, cell int, chord double"), "cells")
        found = {r["cell"]: r for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("chord").alias("chord")).collect()}
        self.first, self.parts_of, self.chord = [], [], []
        for c in range(len(self.pivots)):
            self.first.append(sum(self.parts_of))
            self.parts_of.append(-(-found[c]["n"] // PART_ROWS) if c in found else 0)
            self.chord.append(found[c]["chord"] if c in found else 0.0)
        self.parts = sum(self.parts_of)
        cell = lambda values: F.element_at(F.array(*(F.lit(x) for x in values)), F.col("cell") + 1)
        part = (cell(self.first) + F.pmod(F.xxhash64("vec_id"), cell(self.parts_of))).cast("int")
        parted = celled.select(part.alias("part"), "vec_id", "label", "v").repartition(self.parts, "part").sortWithinPartitions("part")
        self.forests = kept(parted.mapInArrow(_forests(self.length, self.most), "part int, seq int, data binary"), "forests")

    def search(self, anchors: DataFrame, same: bool, k: int, lanes: int, bounded: bool) -> DataFrame:
        """First k of each window of anchors(anchor_id, label, v, lows, highs) and part, as _FOUND rows."""
        routed = anchors.mapInArrow(_route(self.pivots, self.chord, self.first, self.parts_of, self.most, lanes, bounded, self.length), _STREAM)
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("anchor_id", "long"), ("label", "long"), ("v", "array<long>"), ("lows", "array<long>"), ("highs", "array<long>"))]
        forests = self.forests.select("part", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"), "seq", "data", *empty)
        # a part's forest comes first, then its anchors
        stream = forests.unionByName(routed).repartition(max(1, self.parts * lanes), "part", "lane").sortWithinPartitions("part", "lane", "kind", "seq")
        return stream.mapInArrow(_search(self.length, same, k), _FOUND)


def _cells(centres: np.ndarray, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = augmented(centres, most)
        norms = (points * points).sum(axis=1)
        for batch in batches:
            v = augmented(matrix(batch.column("v"), centres.shape[1]), most)
            cell = (norms[None, :] - 2 * (v @ points.T)).argmin(axis=1)
            chord = np.sqrt(((v - points[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), pa.array(cell.astype(np.int32)), pa.array(chord)], names=["vec_id", "label", "v", "cell", "chord"])

    return run


def _forests(length: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows of parts to forests in pieces; a task holds one part at a time."""

    def pieces(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = lambda c: np.concatenate([b.column(c).to_numpy() for b in held])
        data = build(columns("vec_id"), columns("label"), np.concatenate([matrix(b.column("v"), length) for b in held]), most).to_bytes()
        for seq, at in enumerate(range(0, len(data), PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.int32()), pa.array([seq], type=pa.int32()), pa.array([data[at : at + PIECE]], type=pa.binary())], names=["part", "seq", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            part = batch.column("part").to_numpy()
            for a, b in _stretches(part):
                if now is not None and part[a] != now:
                    yield from pieces(now, held)
                    held = []
                now = int(part[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from pieces(now, held)

    return run


def _stretches(*keys: np.ndarray) -> list[tuple[int, int]]:
    """[first, last) of the rows in a row that agree in all keys."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = [0, *np.flatnonzero(new).tolist(), n] if n else [0]
    return list(zip(at, at[1:]))


def _route(centres: np.ndarray, chords: list[float], first: list[int], parts_of: list[int], most: int, lanes: int, bounded: bool, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each anchor to all parts of the cells whose bounds meet one of its windows (of all cells where windows are open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = float(most) ** 0.5
        cap = 2 * np.arcsin(np.minimum(1.0, np.array(chords) / (2 * norm))) if norm else np.zeros(len(chords))
        for batch in batches:
            v = matrix(batch.column("v"), length)
            meets = np.ones((len(v), len(centres)), dtype=bool)
            if bounded and norm:
                f = v.astype(np.float64)
                full = np.sqrt((f * f).sum(axis=1))[:, None] * norm
                with np.errstate(invalid="ignore"):
                    angle = np.nan_to_num(np.arccos(np.clip(f @ centres.T.astype(np.float64) / full, -1.0, 1.0)))
                margin = 1 + 1e-7 * full
                low, high = full * np.cos(np.minimum(np.pi, angle + cap)) - margin, full * np.cos(np.maximum(0.0, angle - cap)) + margin
                for i, (lows, highs) in enumerate(zip(batch.column("lows").to_pylist(), batch.column("highs").to_pylist())):
                    meets[i] = False
                    for a, b in zip(lows, highs):
                        meets[i] |= (high[i] >= a) & (low[i] <= b)
            rows, parts = [], []
            for i, cell in zip(*(x.tolist() for x in np.nonzero(meets))):
                parts += range(first[cell], first[cell] + parts_of[cell])
                rows += [i] * parts_of[cell]
            if not rows:
                continue
            own = batch.take(pa.array(rows, type=pa.int64()))
            ids = own.column("anchor_id")
            lane = (ids.to_numpy() // 100 % lanes).astype(np.int32)
            n = len(rows)
            columns = {"part": pa.array(parts, type=pa.int32()), "lane": pa.array(lane), "kind": pa.array(np.ones(n, dtype=np.int32)), "seq": pa.array(np.zeros(n, dtype=np.int32)), "data": pa.nulls(n, pa.binary())}
            columns |= {c: own.column(c) for c in ("anchor_id", "label", "v", "lows", "highs")}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _search(length: int, same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, forest = None, [], None
        for batch in batches:
            part, lane, kind = (batch.column(c).to_numpy() for c in ("part", "lane", "kind"))
            out: list[tuple[int, int, int, int]] = []
            for a, b in _stretches(part, lane, kind):
                if (part[a], lane[a]) != now:
                    now, data, forest = (part[a], lane[a]), [], None
                own = batch.slice(a, b - a)
                if kind[a] == 0:
                    data += own.column("data").to_pylist()
                    continue
                if forest is None:
                    forest, data = Forest.from_bytes(b"".join(data)), []
                queries = matrix(own.column("v"), length)
                for q, i, label, lows, highs in zip(queries, *(own.column(c).to_pylist() for c in ("anchor_id", "label", "lows", "highs"))):
                    for w, rows in enumerate(forest.search(q, label, same, list(zip(lows, highs)), k, i if same else None)):
                        out += [(i, w, s, j) for s, j in rows]
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor_id", "window", "score", "vec_id"])

    return run


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each anchor and window, with their ``rank``."""
    by = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of vectors(vec_id, label, embedding), for
    rows where ``anchor`` (a condition on vec_id) holds: for each of an anchor's first ``positives`` rows of its label, the
    first ``negatives`` rows of other labels with least * positive <= 100 * score <= most * positive."""
    rows, n, length = prepare(vectors, label, scale)
    spark = vectors.sparkSession
    if n == 0:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = Index(rows, n, length)
    anchors = rows.where(anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("row")).select("anchor_id", "row.label", "row.v")
    anchors = kept(anchors, "anchors")
    lanes = max(1, -(-anchors.count() // LANE))
    none = F.lit(None).cast("long")
    near = first_of(index.search(anchors.select("*", F.array(none).alias("lows"), F.array(none).alias("highs")), True, positives, lanes, False), positives)
    near = kept(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    low = -F.expr(f"(positive_score * -{least} - pmod(positive_score * -{least}, 100)) div 100")
    high = F.expr(f"(positive_score * {most} - pmod(positive_score * {most}, 100)) div 100")
    ways = near.withColumn("low", low).withColumn("high", high).where("low <= high")
    numbered = ways.withColumn("window", F.row_number().over(Window.partitionBy("anchor_id").orderBy("rank")) - 1)
    numbered = kept(numbered, "windows")
    listed = numbered.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w"))
    asked = anchors.join(listed, "anchor_id").select("anchor_id", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = first_of(index.search(asked, False, negatives, lanes, True), negatives)
    out = found.select("anchor_id", "window", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(numbered.select("anchor_id", "window", "positive_id", "positive_score"), ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
