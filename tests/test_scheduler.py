"""Periodic passes: what is due, and runs that are killed between any two writes and made again."""

import pytest

from flowlake import catalog, catalog_io
from flowlake.plans.state import Table
from flowlake.streaming import flows as streaming

SF = "/root/testdata/sf0.001"


class Killed(RuntimeError):
    pass


def test_passes_are_due_once_a_slot(spark, tmp_path):
    ran = []
    ledger = lambda: Table(spark, str(tmp_path), "ledger", streaming.PassScheduler.LEDGER)
    periodic = [streaming.Periodic(n, s, lambda now, n=n: ran.append((n, now))) for n, s in (("a", 10), ("b", 25))]
    second = 1_000_000
    for now in (5, 9, 10, 24, 26, 26, 80, 79, 81):
        streaming.PassScheduler(ledger(), periodic).tick(now * second)  # a new one each time, as after a restart
    assert ran == [("a", 5 * second), ("b", 5 * second), ("a", 10 * second), ("a", 24 * second), ("b", 26 * second), ("a", 80 * second), ("b", 80 * second)]


@pytest.fixture(scope="module")
def inputs(spark):
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    return keep(catalog.located_flows(spark, SF)), keep(catalog.classified_log(spark, SF)), keep(catalog.routes_of(spark, SF).limit(40))


def result(tables):
    return {n: sorted(map(str, (t.log() if "decisions" in n else t.read()).collect())) for n, t in tables.items()}


def passes_of(tables, flows, log, routes):
    measure = lambda wanted: routes.join(wanted.withColumnRenamed("ip", "dst_ip"), "dst_ip", "left_semi").select("dst_ip", "traced_us", "hops")
    return [
        streaming.Periodic("places", 3600, lambda now: streaming.geo_pass(tables, flows, catalog.HOME)),
        streaming.Periodic("apps", 120, lambda now: streaming.app_pass(tables, log, now)),
        streaming.Periodic("traces", 90, lambda now: streaming.trace_pass(tables, flows, now, measure)),
    ]


def test_killed_between_any_two_writes(spark, tmp_path, inputs, monkeypatch):
    now = catalog.now_of(inputs[1], "ts_us")
    whole = catalog_io.pass_tables(spark, str(tmp_path / "whole"))
    streaming.PassScheduler(Table(spark, str(tmp_path / "whole"), "ledger", streaming.PassScheduler.LEDGER), passes_of(whole, *inputs)).tick(now)
    want = result(whole)
    assert all(want[n] for n in ("ip_geo", "geo_decisions", "ip_app", "app_decisions"))
    publish, append = Table.publish, Table.append
    for at in range(1, 9):
        count = [0]

        def counted(write):
            def call(self, *args, **kw):
                out = write(self, *args, **kw)
                count[0] += 1
                if count[0] == at:
                    raise Killed
                return out

            return call

        root = str(tmp_path / f"killed{at}")
        tables = catalog_io.pass_tables(spark, root)
        schedule = lambda: streaming.PassScheduler(Table(spark, root, "ledger", streaming.PassScheduler.LEDGER), passes_of(tables, *inputs))
        monkeypatch.setattr(Table, "publish", counted(publish))
        monkeypatch.setattr(Table, "append", counted(append))
        with pytest.raises(Killed):
            schedule().tick(now)
        monkeypatch.setattr(Table, "publish", publish)
        monkeypatch.setattr(Table, "append", append)
        schedule().tick(now)
        assert result(tables) == want, at
        assert schedule().tick(now) == []
