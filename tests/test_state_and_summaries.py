"""Bucketed tables with several writers, capped summaries, tiers of newest rows, and appends by batch id."""

import random

import pytest
from pyspark.sql import functions as F

from flowlake.plans.state import BucketedTable, Conflict
from flowlake.sources import sinks
from flowlake.streaming import capped

SCHEMA = "ip string, n long, source string"


def rows_of(table, version=None):
    return {r["ip"]: (r["n"], r["source"]) for r in table.read(version).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "t", SCHEMA, buckets=8)
    update = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert rows_of(table) == {} and table.version() == 0
    assert table.upsert(update([(f"k{i}", i, "manual" if i == 3 else "a") for i in range(100)])) == 1
    first = table.manifest(1)
    assert table.upsert(update([("k1", 100, "b"), ("k3", 100, "b")])) == 2
    second = table.manifest(2)
    assert 1 <= sum(first[b] != second[b] for b in range(8)) <= 2
    want = {f"k{i}": (i, "manual" if i == 3 else "a") for i in range(100)} | {"k1": (100, "b")}
    assert rows_of(table) == want and rows_of(table, 1)["k1"] == (1, "a")
    assert table.upsert(update([])) == 3 and rows_of(table) == want


@pytest.mark.parametrize("same", [True, False])
def test_a_writer_that_comes_too_late_loses_nothing(spark, tmp_path, monkeypatch, same):
    one, two = (BucketedTable(spark, str(tmp_path), "t", SCHEMA, buckets=8) for _ in range(2))
    update = lambda rows: spark.createDataFrame(rows, SCHEMA)
    one.upsert(update([(f"k{i}", 0, "a") for i in range(50)]))
    bucket = {r["ip"]: r["b"] for r in one.read().select("ip", one._bucket().alias("b")).collect()}
    other = next(k for k in bucket if k != "k0" and (bucket[k] == bucket["k0"]) == same)
    publish, written = one._publish, []
    write = one._write

    def late(version, manifest):
        if len(written) == 1 and one.version() == 1:
            two.upsert(update([(other, 2, "two")]))
        return publish(version, manifest)

    monkeypatch.setattr(one, "_publish", late)
    monkeypatch.setattr(one, "_write", lambda *a: (written.append(1), write(*a))[1])
    assert one.upsert(update([("k0", 1, "one")])) == 3
    got = rows_of(one)
    assert got["k0"] == (1, "one") and got[other] == (2, "two") and len(got) == 50
    # what was written is used again unless the same bucket changed
    assert len(written) == (2 if same else 1)


def test_a_writer_gives_up_in_the_end(spark, tmp_path, monkeypatch):
    table = BucketedTable(spark, str(tmp_path), "t", SCHEMA, buckets=4, attempts=2)
    monkeypatch.setattr(table, "_publish", lambda *a: False)
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([("k", 1, "a")], SCHEMA))


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_summaries_merge_within_their_bound(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(4) * 10**6, rng.choice("xy"), f"k{int(rng.paretovariate(0.7)) % 60}", rng.randrange(1, 500)) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "second_us long, axis string, key string, octets long")
    parts = [frame.where(F.col("octets") % 3 == k) for k in range(3)]
    united = capped.summarise(parts[0], n=n)
    for p in parts[1:]:
        united = united.unionByName(capped.summarise(p, n=n))
    one = capped.merged(united, ("axis",), n).collect()
    for axis in "xy":
        exact = {}
        for _, a, k, o in rows:
            if a == axis:
                exact[k] = exact.get(k, 0) + o
        facts = next(r for r in one if r["axis"] == axis and r["key"] is None)
        kept = {r["key"]: r["bytes"] for r in one if r["axis"] == axis and r["key"] is not None}
        total = sum(exact.values())
        assert facts["total"] == total and len(kept) <= n and facts["lost"] * (n + 1) <= total
        assert all(kept.get(k, 0) <= b <= kept.get(k, 0) + facts["lost"] for k, b in exact.items())
        assert {k for k, b in exact.items() if b * (n + 1) > total} <= set(kept)
        if n == 1000:
            assert kept == exact and facts["lost"] == 0


def test_newest_rows_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, 1_704_067_200_000_000 + i * 60_000_000) for i in range(600)] + [(9000, None), (9001, None)]
    frame = spark.createDataFrame(rows, "flow_id long, recv_us long")
    for batch in (0, 1, 1, 2):
        sinks.append_flows(frame.where(F.coalesce(F.floor(F.col("flow_id") / 200), F.lit(0)) % 45 == batch), path, batch_id=batch)
    assert spark.read.parquet(path).count() == 602
    for n in (0, 1, 60, 61, 100, 599, 600, 5000):
        assert sorted(r["flow_id"] for r in sinks.newest(spark, path, n).collect()) == list(range(600 - min(n, 600), 600))
    gone = sinks.keep_newest(spark, path, 100)
    assert len({g.split("/")[1] for g in gone}) == 8 and sorted(r["flow_id"] for r in sinks.newest(spark, path, 100).collect()) == list(range(500, 600))
    # rows without a time never expire
    sinks.expire(spark, path, 2_000_000_000_000_000)
    assert sorted(r["flow_id"] for r in spark.read.parquet(path).collect()) == [9000, 9001]
