"""SQL functions over addresses against the standard library, on valid and malformed texts."""

from __future__ import annotations

import ipaddress
import random

from flowlake.functions.ip import BOGONS
from flowlake.functions.register import register_functions

ODD = "1.2.3 1.2.3.4. 1.2.3.256 01.2.3.4 x :: ::1 : ::: 1:2:3:4:5:6:7 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7:8:9 1::2:3:4:5:6:7:8 1::3:4:5:6:7:8 1::2::3 ::ffff:1.2.3.4 ::1.2.3.400 64:ff9b::192.0.2.33 FE80::ABCD 12345::1 g::1 1: :1 1:::2 ::ffff:102:304 1.2.3.4/8".split()
NETS = "0.0.0.0/0 10.0.0.0/8 172.16.0.0/12 192.168.1.0/27 1.2.3.4 1.2.3.4/32 1.2.3.4/33 1.2.3.4/ /8 junk/8 ::/0 fe80::/10 2001:10::/28 2001:db8::/33 ::1 ::1/129 1.2.3.4/8/8".split()


def digits(text: str) -> str | None:
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{int(a):0{a.max_prefixlen // 4}x}"


def within(a: str | None, c: str | None) -> bool | None:
    if a is None or c is None:
        return None
    try:
        return ipaddress.ip_address(a) in ipaddress.ip_network(c, strict=False)
    except ValueError:
        return False


def bogon(a: str | None) -> str | None:
    return None if a is None else next((name for net, name in BOGONS if within(a, net)), None)


def addresses() -> list[str | None]:
    rng = random.Random(2)
    some = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(100)] + [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(100)]
    for net, _ in BOGONS:
        n = ipaddress.ip_network(net)
        first, last = int(n.network_address), int(n.broadcast_address)
        kind = type(n.network_address)
        some += [str(kind(i)) for i in (first - 1, first, last, last + 1) if 0 <= i < 2**n.max_prefixlen]
    some += [ipaddress.IPv6Address(rng.getrandbits(128)).exploded.upper() for _ in range(20)]
    return [*some, *ODD, "", None]


def test_addresses_in_sql(spark):
    register_functions(spark)
    rows = addresses()
    spark.createDataFrame([(a,) for a in rows], "ip string").createOrReplaceTempView("asked_ips")
    spark.createDataFrame([(c,) for c in [*NETS, "", None]], "cidr string").createOrReplaceTempView("asked_nets")
    one = spark.sql("SELECT ip, ip_digits(ip) AS d, bogon_class(ip) AS c FROM asked_ips")
    got = {r["ip"]: (r["d"], r["c"]) for r in one.collect()}
    assert got == {a: (None if a is None else digits(a), bogon(a)) for a in rows}
    assert {"carrier-grade NAT", "ORCHID", "IPv4-mapped"} <= {c for _, c in got.values()}
    pairs = spark.sql("SELECT /*+ BROADCAST(asked_nets) */ ip, cidr, in_cidr(ip, cidr) AS w FROM asked_ips CROSS JOIN asked_nets")
    for r in pairs.collect():
        assert r["w"] == within(r["ip"], r["cidr"]), tuple(r)
    assert "Python" not in one._jdf.queryExecution().toString() + pairs._jdf.queryExecution().toString()
