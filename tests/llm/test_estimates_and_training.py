"""Estimates that fingerprints carry, and the training of the quality classifier against a plain version."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.llm import fingerprint, quality

LONG = 3000


def test_fingerprints_estimate_size_and_containment(spark):
    rng = random.Random(12)
    words = [f"v{rng.randrange(10**9)}" for _ in range(LONG)]
    texts = ["a b c d e f g h", "a b c d e f g h i j", None, "", "alone", " ".join(words), " ".join(words + [f"u{i}" for i in range(LONG)]), "zz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(rows).collect()}
    # sketches of few shingles are whole, so these are exact
    assert [got[i]["distinct_shingles"] for i in (0, 1, 2, 3, 4)] == [4.0, 6.0, 0.0, 0.0, 1.0]
    assert got[0]["within_next"] == pytest.approx(1.0) and got[0]["near_next"] == pytest.approx(4 / 6)
    assert got[1]["within_next"] == 0.0 and got[2]["within_next"] == 1.0 and got[3]["within_next"] == 1.0
    assert got[4]["within_next"] == 0.0
    # a long text lies whole in the next, which is twice as long
    error = 4 / fingerprint.SKETCH_SIZE**0.5
    assert abs(got[5]["distinct_shingles"] / (LONG - 4) - 1) < error and abs(got[6]["distinct_shingles"] / (2 * LONG - 4) - 1) < error
    assert got[5]["within_next"] > 0.7 and got[6]["within_edited"] < 0.75
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("within_edited", "within_next"))


def plain_ftrl(rows: list[tuple[list[int], int]]) -> dict[int, float]:
    """Weights after the epochs, one number at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i: int) -> float:
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    good = sum(y for _, y in rows)
    ratio = math.sqrt(min(16, max(1 / 16, good / max(1, len(rows) - good))))
    counts = {0: max(1.0, ratio), 1: max(1.0, 1 / ratio)}
    for _ in range(quality.EPOCHS):
        for places, y in rows:
            x = {i: 1 / math.sqrt(max(1, len(places) - 1)) for i in places} | {0: 1.0}
            w = {i: weight(i) for i in places}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in places)))
            for i in places:
                g = counts[y] * (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_training_is_plain_ftrl_averaged_over_shards(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARD_ROWS", 100)
    rng = random.Random(5)
    data = [(i, " ".join(f"w{rng.randrange(200)}" + ("" if i % 4 else "!!") for _ in range(20)), int(i % 4 != 0)) for i in range(240)]
    docs = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id long, quality int")
    got = quality.train(docs, labels)
    shard = {r["doc_id"]: r["s"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("s")).collect()}
    want = np.zeros(2**quality.BITS)
    for s in (0, 1):
        mine = [d for d in data if shard[d[0]] == s and zlib.crc32(str(d[0]).encode()) % 5 != 0]
        assert len(mine) > 50
        mine.sort(key=lambda d: (d[0] * 0x9E3779B97F4A7C15 % 2**61 % (2**61 - 1), d[0]))
        for i, w in plain_ftrl([(quality.features([t])[0].tolist(), y) for _, t, y in mine]).items():
            want[i] += w / 2
    assert np.count_nonzero(want) > 300 and np.allclose(got, want, rtol=1e-4, atol=1e-5)
