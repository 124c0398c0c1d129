from pyspark.sql import functions as F

from flowlake import catalog
from flowlake.operators import detect, stats
from flowlake.schemas import APP_DECISIONS, GEO_DECISIONS, HOPS, IP_APP, IP_GEO
from flowlake.plans.state import Table
from flowlake.sources.sinks import live_sink
from flowlake.streaming import flows as streaming

SF = "/root/testdata/sf0.001"


def written(spark, tmp_path, files=3):
    rows = catalog.marked_flows(spark, SF)
    path = str(tmp_path / "flows")
    rows.orderBy("recv_us").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    return spark.read.parquet(path), stream


def test_partials_roll_up_to_the_batch_answer(spark, tmp_path):
    batch, stream = written(spark, tmp_path)
    q = live_sink(streaming.second_partials(stream, "1 second"), "partials", mode="complete")
    q.awaitTermination()
    now = batch.agg(F.max("recv_us")).first()[0] // 1_000_000 * 1_000_000 - 1
    partials = spark.table("partials")
    got = {(r["axis"], r["key"]): r["bytes"] for r in streaming.rollup_partials(partials, now, 60).collect()}
    whole = stats.axis_rollup(batch.withColumn("recv_us", F.floor(F.col("recv_us") / 1_000_000) * 1_000_000), now, 60)
    assert got == {(r["axis"], r["key"]): r["bytes"] for r in whole.collect()} and got
    assert streaming.cap_keys(partials, 1).groupBy("second_us", "axis").count().where("count > 1").count() == 0


def test_fan_in_state_equals_batch(spark, tmp_path):
    batch, stream = written(spark, tmp_path)
    q = streaming.fan_in_stream(stream, 60, 5).writeStream.format("memory").queryName("fan").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    key = ["flow_id", "distinct_sources", "flag"]
    assert sorted(tuple(r) for r in spark.table("fan").select(key).collect()) == sorted(tuple(r) for r in detect.fan_in(batch, 60, 5).select(key).collect())


def test_resume_and_sinks(spark, tmp_path):
    batch, stream = written(spark, tmp_path)
    seen = []
    dims = lambda: {"corrections": spark.createDataFrame([], "ip string, lat double, lon double, country string"), "ip_app": spark.createDataFrame([], IP_APP)}
    sinks = [lambda b, i: seen.append(b.count()), streaming.enriching_sink(dims, lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")))]
    for _ in range(2):  # the second run finds nothing new
        streaming.run(streaming.resume(stream), sinks, str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == batch.count() == spark.read.parquet(str(tmp_path / "out")).count()


def test_all_passes_run_on_tables(spark, tmp_path):
    root = str(tmp_path)
    schemas = {"ip_geo": IP_GEO, "geo_decisions": GEO_DECISIONS, "ip_app": IP_APP, "app_decisions": APP_DECISIONS, "routes": f"dst_ip string, traced_us long, hops {HOPS}, hop_count int"}
    tables = {n: Table(spark, root, n, s) for n, s in schemas.items()}
    tables["routes"].publish(catalog.routes_of(spark, SF))
    flows, log = catalog.located_flows(spark, SF), catalog.classified_log(spark, SF)
    now = catalog.now_of(log, "ts_us")
    streaming.run_passes(spark, now, tables, flows, log, catalog.HOME)
    first = tables["geo_decisions"].log().count(), tables["app_decisions"].log().count()
    assert min(first) > 0
    assert streaming.run_passes(spark, now, tables, flows, log, catalog.HOME) == {"ip_geo": 2, "ip_app": 2}
    assert (tables["geo_decisions"].log().count(), tables["app_decisions"].log().count()) == first


def test_second_partials_of_one_axis_are_those_of_all(spark):
    rows = [(i, 1704067200000000 + i * 250_000, i % 3 * 100, 1 + i, f"192.168.0.{i % 4}", f"93.0.0.{i % 5}", 0, 64512, True, False, None, "FR", ["https", "ssh", None][i % 3]) for i in range(40)]
    kinds = "flow_id long, recv_us long, octets long, packets long, src_addr string, dst_addr string, src_as int, dst_as int, src_home boolean, dst_home boolean, src_country string, dst_country string, service string"
    marked = spark.createDataFrame(rows, kinds)
    every, some = streaming.second_partials(marked).collect(), streaming.second_partials(marked, axes=["service"]).collect()
    assert sorted(map(str, some)) == sorted(str(r) for r in every if r["axis"] == "service") and 0 < len(some) < len(every)
