"""13. Vector code compression: a product code whose nearest entries are found by equal-average search.

Vectors are cut into equal parts, each part position has a codebook of integer entries, and a vector's code is the index
of the nearest entry of each part. A part and an entry whose component sums differ by g are at least g^2 / width apart
(squared distance), so entries are sorted by their sums and looked at outward from the part's own sum, until g^2 / width
strictly exceeds the best distance so far on both sides; strictly, since an equally near entry of a lower index wins.
Parts of nearly one sum go outward together, as one product of matrices.

Training rounds run over all rows: tasks assign their rows and hand on one sum and count an entry and component, so what is
shuffled and what reaches the driver is bounded by entries x dimension, whatever the number of rows. Rows are kept once,
as integers, in the shared folder.

Cases: null vectors and null or non-finite components drop the row; shorter vectors, empty ones included, count as ending
in zeros, up to the longest length rounded up to a multiple of the parts; fewer rows than entries give fewer entries;
null vec_ids come last; rows with one vec_id are coded each, and start entries in the order of their components; an empty
table gives no rows; other input columns do not matter and are not returned. A squared error beyond 63 bits raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import kept
from flowlake.llm.vectors import EXACT, exact, floored, matrix, usable

#: Rows a task of the kept table; a label table of more rows than LABELS is joined without a broadcast.
TASK_ROWS, LABELS = 16_384, 100_000
#: Parts that go outward together, and entries they take at a time.
TOGETHER, STEP = 256, 32


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each row; the lower index where two are as near."""
    n, width = part.shape
    most = max(int(np.abs(part).max(initial=0)), int(np.abs(entries).max(initial=0)))
    safe = 4 * width * width * most * most < EXACT
    part, entries = exact(part, safe), exact(entries, safe)
    by_sum = np.argsort(entries.sum(axis=1), kind="stable")
    ordered = entries[by_sum]
    sums, squares = ordered.sum(axis=1), (ordered * ordered).sum(axis=1)
    own = part.sum(axis=1)
    rows = np.argsort(own, kind="stable")
    index, distance = np.empty(n, dtype=np.int64), np.empty(n, dtype=part.dtype)
    for first in range(0, n, TOGETHER):
        at = rows[first : first + TOGETHER]
        x, s = part[at], own[at]
        xx = (x * x).sum(axis=1)
        best, which = None, None
        low = high = int(np.searchsorted(sums, s[len(at) // 2]))  # looked at so far: [low, high)
        while True:
            takes = []
            # the gap to the next entry on each side; rows beyond it have none
            if high < len(sums) and (best is None or bool((np.maximum(sums[high] - s, 0) ** 2 <= best * width).any())):
                takes.append((high, high := min(high + STEP, len(sums))))
            if low > 0 and (best is None or bool((np.maximum(s - sums[low - 1], 0) ** 2 <= best * width).any())):
                takes.append((max(low - STEP, 0), low))
                low = takes[-1][0]
            if not takes:
                break
            for a, b in takes:
                d = xx[:, None] - 2 * (x @ ordered[a:b].T) + squares[None, a:b]
                m = d.min(axis=1)
                i = np.where(d == m[:, None], by_sum[None, a:b], len(sums)).min(axis=1)
                if best is None:
                    best, which = m, i
                else:
                    better = (m < best) | ((m == best) & (i < which))
                    best, which = np.where(better, m, best), np.where(better, i, which)
        index[at], distance[at] = which, best
    return index, distance


def prepare(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the usable rows as integers, and the width of a part (0 where there is no row)."""
    good = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", "embedding")
    n, longest = good.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = -(-max(longest or 0, 1) // parts) if n else 0
    rows = good.select("vec_id", "label", floored(F.col("embedding"), scale, width * parts).alias("v"))
    return kept(rows.repartition(-(-n // TASK_ROWS) or 1), "vectors"), width


def first_books(rows: DataFrame, parts: int, width: int, entries: int) -> np.ndarray:
    """The parts of the rows with the smallest vec_ids, as (part, entry, position)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), parts * width)
            for p in range(parts):
                part = v[:, p * width : (p + 1) * width]
                index, _ = nearest(part, books[p])
                np.add.at(total[p], index, part)
                count[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(count)
        cells = lambda x: pa.array(np.repeat(x, width))
        yield pa.RecordBatch.from_arrays(
            [cells(p.astype(np.int32)), cells(e.astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))), pa.array(total[p, e].reshape(-1)), cells(count[p, e])],
            names=["part", "entry", "position", "total", "n"],
        )

    return run


def train(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after ``rounds`` rounds of assigning every part and moving entries to the floor of their parts' mean."""
    for _ in range(rounds):
        found = rows.select("v").mapInArrow(_sums(books), "part int, entry int, position int, total long, n long")
        books = books.copy()
        for r in found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits a part (more where there are over 256 entries)."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{i:0{digits}x}" for i in range(entries)], dtype=object)
        for batch in batches:
            v = matrix(batch.column("v"), parts * width)
            code, error = np.full(len(v), "", dtype=object), np.zeros(len(v), dtype=object)
            for p in range(parts):
                index, distance = nearest(v[:, p * width : (p + 1) * width], books[p])
                code, error = code + names[index], error + distance
            errors = [int(x) for x in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), type=pa.string()), pa.array(errors, type=pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of vectors(vec_id, label, embedding)."""
    rows, width = prepare(vectors, parts, scale)
    books = first_books(rows, parts, width, entries)
    if books.size:
        books = train(rows, books, rounds)
    codes = kept(encode(rows, books), "codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if by_label.limit(LABELS + 1).count() <= LABELS:
        by_label = F.broadcast(by_label)
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
