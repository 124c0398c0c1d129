"""6. Language ID: rank-order profiles of the most frequent letter n-grams, compared by out-of-place distance.

A profile is the ranking of the PROFILE most frequent 1- to 3-grams of letters and word gaps. A document goes to the
language whose profile has the least summed rank difference to its own; n-grams missing from a profile cost PROFILE.

Cases: null texts and texts without a letter are ``und`` with score 0; ties go to the language first in order; with no
training rows every document is ``und``; repeated rows are judged each; other columns are kept, lang_pred and score
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlake.llm.training import drawn, fold

PROFILE = 300
#: At most about so many training documents of each language make its profile, chosen by a hash of doc_id and text.
TRAINING_ROWS = 500
UNKNOWN = "und"
_GAP = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (up to three code points of 21 bits) and counts of a text's n-grams; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    points = np.concatenate([[_GAP], np.where(_letters()[points], points, _GAP), [_GAP]])
    points = points[np.concatenate([[True], (points[1:] != _GAP) | (points[:-1] != _GAP)])]
    if len(points) < 2:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    two = (points[:-1] << 21) | points[1:]
    three = (two[:-1] << 21) | points[2:]
    return np.unique(np.concatenate([points[points != _GAP], two, three]), return_counts=True)


def ranking(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Codes by falling count, then code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


def train(docs: DataFrame, keep=None, bound: int = TRAINING_ROWS) -> dict[str, list[int]]:
    """Profiles of the languages in docs(doc_id, text, lang); the driver gets PROFILE codes a language."""
    keep = keep if keep is not None else fold(F.col("doc_id"), 4) != 2
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & keep)
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(bound)) / F.count("*")).alias("share"))
    chosen = rows.join(F.broadcast(shares), "lang").where(drawn(F.xxhash64("doc_id", "text"), F.col("share")))
    # repeated rows do not enlarge the sample
    chosen = chosen.groupBy("lang", "doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, []).append(grams(text))
            for lang, parts in found.items():
                codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Classifier:
    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, dtype=np.int64)
        for k, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def judge(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if len(codes) == 0 or not self.languages:
            return UNKNOWN, 0.0
        own = ranking(codes, counts)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = -1
        at = np.where(self.codes[at] == own, at, -1)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        order = np.argsort(away, kind="stable")
        best = int(away[order[0]])
        other = int(away[order[1]]) if len(order) > 1 else PROFILE * len(own)
        return self.languages[order[0]], other / (best + other) if best + other else 1.0


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """docs plus lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(profiles)
        for b in batches:
            judged = [classifier.judge(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in judged], pa.string()), pa.array([x[1] for x in judged], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.withColumn("lang_pred", F.lit("").cast("string")).withColumn("score", F.lit(0.0)).schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    judged = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs))
    return judged.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
