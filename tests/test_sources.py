import json
import struct

import pytest
from pyspark.sql import functions as F

from flowlake.plans.state import Table, merge, seed_if_absent
from flowlake.schemas import HOPS
from flowlake.sources import flowd, pcap, sinks, text

GOLDEN = bytes.fromhex(
    "601700000003faae" "6a0caf4c000d4acf" "10060000" "7f000001" "cb00710a" "c0000204" "c00002fe" "075bdc30" "0000000000000001" "0000000000000028"
    "0000000000000001" "0d9dcb486a0caf4c" "000000000009" "0000" "0d9d75580d9d7558" "0000000000000000" "00180000"
)


def test_golden_flow_record():
    (r,) = flowd.records(GOLDEN)
    expected = dict(protocol=6, tcp_flags=0x10, tos=0, agent_addr="127.0.0.1", src_addr="203.0.113.10", src_port=1883, dst_addr="192.0.2.4", dst_port=56368, gateway_addr="192.0.2.254", packets=1, octets=40, if_index_in=0, if_index_out=1, netflow_version=9, dst_mask=24, recv_sec=0x6A0CAF4C, recv_usec=0x000D4ACF)
    assert {k: r[k] for k in expected} == expected


def test_flowd_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(GOLDEN * 3)
    (tmp_path / "b.log").write_bytes(b"")
    (tmp_path / "c.log").write_bytes(GOLDEN + GOLDEN[:50])
    (tmp_path / "d.log").write_bytes(b"\x50" + GOLDEN[1:])
    (tmp_path / "e.log").write_bytes(GOLDEN[:1] + b"\x18" + GOLDEN[2:] + b"\0\0\0\0")
    rows = flowd.read_flowd(spark, str(tmp_path)).collect()
    assert sum(r["error"] is None for r in rows) == 4
    assert sorted(r["error"].split()[0] for r in rows if r["error"]) == ["payload", "truncated", "unsupported"]
    with pytest.raises(Exception, match="truncated record"):
        flowd.read_flowd(spark, str(tmp_path / "c.log"), "FAILFAST").collect()


def hello(name):
    sni = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name
    ext = struct.pack(">HH", 10, 2) + b"\0\0" + struct.pack(">HH", 0, len(sni)) + sni
    body = b"\x03\x03" + bytes(32) + b"\0" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def test_server_names():
    assert pcap.server_name(hello(b"Example.COM")) == "example.com"
    assert pcap.server_name(b"\x17" + hello(b"a.b")[1:]) is None
    for cut in range(len(hello(b"a.example"))):
        assert pcap.server_name(hello(b"a.example")[:cut]) is None
    assert pcap.server_name(hello(b"bad name")) is None and pcap.server_name(hello(b"a" * 254)) is None


def frame(payload, v6=False, vlan=False):
    tcp = struct.pack(">HHIIBBHHH", 1234, 443, 0, 0, 5 << 4, 0, 0, 0, 0) + payload
    ip = (b"\x60" + bytes(5) + b"\x06" + b"\0" + bytes(15) + b"\x01" + bytes(15) + b"\x02" if v6 else b"\x45" + bytes(8) + b"\x06" + bytes(2) + bytes([10, 0, 0, 1, 93, 1, 2, 3])) + tcp
    kind = struct.pack(">H", 0x86DD if v6 else 0x0800)
    return bytes(12) + (b"\x81\0\0\x01" if vlan else b"") + kind + ip


@pytest.mark.parametrize("order,magic,unit", [("<", b"\xd4\xc3\xb2\xa1", 10**6), (">", b"\xa1\xb2\xc3\xd4", 10**6), ("<", b"\x4d\x3c\xb2\xa1", 10**9)])
def test_captures(spark, tmp_path, order, magic, unit):
    data = magic + bytes(16) + struct.pack(order + "I", 1)
    for k, f in enumerate([frame(hello(b"a.example")), frame(hello(b"b.example"), v6=True), frame(hello(b"c.example"), vlan=True), frame(b"junk"), b"short"]):
        data += struct.pack(order + "IIII", 100 + k, unit // 2, len(f), len(f)) + f
    (tmp_path / "x.pcap").write_bytes(data + b"\0\0\0")
    (tmp_path / "y.pcap").write_bytes(b"no capture")
    rows = sorted(pcap.read_pcap(spark, str(tmp_path)).collect())
    assert [(r["ts_us"], r["sni"], r["dst_port"]) for r in rows] == [(100_500_000, "a.example", 443), (101_500_000, "b.example", 443), (102_500_000, "c.example", 443)]
    assert rows[1]["src_addr"] == "::1" and rows[0]["dst_addr"] == "93.1.2.3"


def test_netflow_lines(spark, tmp_path):
    item = {"fields": {"src": "10.0.0.1", "dst": "8.8.8.8", "src_port": 5, "dst_port": 443, "protocol": "TCP", "in_bytes": 0, "out_bytes": 70, "in_packets": 2, "out_packets": 9, "first_switched": 10, "last_switched": 30}, "tags": {"source": "r"}, "timestamp": 1700000000123}
    lines = [json.dumps(item), json.dumps([item, {"tags": {}}]), "", "   ", "{bad", json.dumps({"timestamp": 5})]
    (tmp_path / "n.json").write_text("\n".join(lines))
    flows, bad = text.read_netflow_json(spark, str(tmp_path / "n.json"))
    rows = flows.collect()
    assert len(rows) == 2 and [r["value"] for r in bad.collect()] == ["{bad"]
    r = rows[0]
    assert (r["protocol"], r["octets"], r["packets"], r["sys_uptime_ms"], r["recv_sec"], r["recv_usec"], r["netflow_version"]) == (6, 70, 2, 30, 1700000000, 123000, 9)


def test_small_text_sources(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("# comment\nhttps\t443/tcp\ndomain\t53/udp\nhttps\t443/tcp\nb?d\t7/sctp\n")
    services = text.read_services(spark, str(tmp_path / "s.tsv"))
    assert services.count() == 4
    found = {r["rule"]: r["violations"] for r in text.check_services(services, 3).collect()}
    assert found == {"name_is_plain_ascii": 1, "proto_is_tcp_or_udp": 1, "port_is_16_bit": 0, "key_is_unique": 1, "row_count": 1}
    (tmp_path / "b.csv").write_text("network,latitude,longitude,country,city_en,city_any\n93.1.2.0/24,1.5,2.5,DE,,Köln\n93.1.0.0/16,3,4,FR,Paris,\n9.9.9.0/24,,1,US,,\n")
    blocks = text.read_geo_blocks(spark, str(tmp_path / "b.csv"))
    assert sorted((r["ip_hi"] - r["ip_lo"] + 1, r["city"]) for r in blocks.collect()) == [(256, "Köln"), (65536, "Paris")]
    report = json.dumps({"report": {"hubs": [{"count": 1, "host": "192.168.0.1", "Avg": 0.5}, {"count": 2, "host": "???", "Avg": 0.0}, {"count": 3, "host": "93.1.2.9", "Avg": 9.5}]}})
    reports = spark.createDataFrame([("93.1.2.9", 5, report), ("1.1.1.1", 6, '{"report":{"hubs":[]}}')], "dst_ip string, traced_us long, json string")
    (route,) = text.parse_trace_reports(reports, blocks, (-45.0, -131.0)).collect()
    assert route["hop_count"] == 2 and [h["lat"] for h in route["hops"]] == [-45.0, 1.5] and route["hops"][1]["country"] == "DE"
    features = {"features": [{"geometry": {"coordinates": [1.23456, 5.0]}, "properties": {"name": "Bay, Chile "}}, {"geometry": None, "properties": {"name": "x"}}, {"geometry": {"coordinates": [2.0, 3.0]}, "properties": {"name": "Plain"}}]}
    (tmp_path / "f.json").write_text(json.dumps(features))
    rows = text.read_features(spark, str(tmp_path / "f.json"), "landing").collect()
    assert [(r["lon"], r["country"]) for r in rows] == [(1.2346, "Chile"), (2.0, None)]


def test_state_tables(spark, tmp_path):
    schema = "ip string, lat double, source string, first_seen long"
    t = Table(spark, str(tmp_path), "places", schema, keep_versions=2)
    assert t.version() is None and t.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert t.upsert(rows(("a", 1.0, "observed", 1), ("m", 2.0, "manual", 1)), keep=("first_seen",)) == 1
    t.upsert(rows(("a", 5.0, "observed", 9), ("m", 6.0, "observed", 9), ("b", 7.0, "observed", 9)), keep=("first_seen",))
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", 5.0, "observed", 1), ("b", 7.0, "observed", 9), ("m", 2.0, "manual", 1)]
    assert t.read(1).count() == 2
    t.publish(t.read())
    assert not (tmp_path / "places" / "v=1").exists()
    t.append(rows(("z", 0.0, "x", 0)))
    assert t.log().count() == 1
    seeded = seed_if_absent(rows(("a", 1.0, "s", 0)), rows(("a", 2.0, "s", 0), ("c", 3.0, "s", 0), ("c", 3.0, "s", 0)), "ip")
    assert sorted((r["ip"], r["lat"]) for r in seeded.collect()) == [("a", 1.0), ("c", 3.0)]
    assert merge(rows(), rows(("q", 1.0, "s", 2))).count() == 1


def test_partitioned_appends(spark, tmp_path):
    hour = sinks.HOUR
    flows = spark.createDataFrame([(i, i * hour // 2) for i in range(10)], "flow_id long, recv_us long")
    sinks.append_flows(flows, str(tmp_path / "f"))
    got = sinks.read_window(spark, str(tmp_path / "f"), hour, 3 * hour)
    assert sorted(r["flow_id"] for r in got.collect()) == [3, 4, 5, 6]
    assert "PartitionFilters: [isnotnull(recv_hour" in got._jdf.queryExecution().toString()
    assert len(sinks.expire(spark, str(tmp_path / "f"), 2 * hour)) == 2
    assert spark.read.parquet(str(tmp_path / "f")).count() == 6
    sinks.append_sni(flows.withColumnRenamed("recv_us", "ts_us"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).select("recv_hour").distinct().count() == 1


def test_seed_rules(spark):
    from flowlake.sources.app_rules import APP_RULES, SEEDS, seed_app_rules

    own = spark.createDataFrame([(SEEDS[0][0], "Mine", "own", 1.0, "manual")], APP_RULES)
    rows = seed_app_rules(spark, own)
    assert rows.count() == len({s[0] for s in SEEDS}) and rows.where("app = 'Mine'").count() == 1
    assert seed_app_rules(spark).count() == rows.count()


def test_files_beyond_the_bound_are_errors(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(GOLDEN * 3)
    (tmp_path / "b.log").write_bytes(GOLDEN)
    rows = flowd.read_flowd(spark, str(tmp_path), most=200).collect()
    assert sum(r["error"] is None for r in rows) == 1 and [r["error"].split(":")[0] for r in rows if r["error"]] == ["file too large"]
    with pytest.raises(ValueError, match="too large"):
        pcap.read_pcap(spark, str(tmp_path), most=200)


def test_a_lost_pointer_falls_back_to_the_newest_whole_version(spark, tmp_path):
    table = Table(spark, str(tmp_path), "t", "ip string, n long")
    for n in (1, 2):
        table.publish(spark.createDataFrame([("a", n)], "ip string, n long"))
    assert table.version() == 2
    (tmp_path / "t" / "CURRENT").unlink()
    (tmp_path / "t" / ".CURRENT.crc").unlink(missing_ok=True)
    (tmp_path / "t" / "v=3").mkdir()  # a version cut off before its end
    assert table.version() == 2 and table.read().first()["n"] == 2
    assert table.publish(spark.createDataFrame([("a", 3)], "ip string, n long")) == 3 and table.read().first()["n"] == 3


def test_decisions_of_a_repeated_pass_are_told_once(spark, tmp_path):
    table = Table(spark, str(tmp_path), "d", "ip string")
    rows = spark.createDataFrame([("a",), ("b",)], "ip string")
    table.append(rows, 1)
    table.append(rows, 1)
    table.append(rows.limit(1), 2)
    assert table.log().count() == 3 and table.log(1).count() == 2
    table.append(rows)
    assert table.log(0).count() == 2
