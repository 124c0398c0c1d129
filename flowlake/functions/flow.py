"""Labels and times of flows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol numbers and names, well-known ports.
PROTOCOL_KEYS = {6: "tcp", 17: "udp", 1: "icmp", 58: "icmp6", 2: "igmp", 47: "gre", 50: "esp", 51: "esp", 132: "sctp", 89: "ospf"}
PROTOCOL_NUMBERS = {"icmp": 1, "igmp": 2, "tcp": 6, "udp": 17, "gre": 47, "esp": 50, "ah": 51, "icmp6": 58, "ipv6-icmp": 58, "icmpv6": 58}


def recv_us(sec: Column, usec: Column) -> Column:
    """Microseconds of receipt; null without seconds."""
    return sec.cast("bigint") * 1_000_000 + F.coalesce(usec.cast("bigint"), F.lit(0))


def flow_end_us(recv_sec: Column, uptime_ms: Column, start_ms: Column, finish_ms: Column) -> Column:
    """Wall-clock end of a flow from the exporter's uptime; null if an input is missing or the time is negative."""
    end = recv_sec.cast("bigint") * 1_000_000 - (uptime_ms.cast("bigint") - finish_ms.cast("bigint")) * 1000
    return F.when((end >= 0) & start_ms.isNotNull(), end)


def flow_start_us(recv_sec: Column, uptime_ms: Column, start_ms: Column, finish_ms: Column) -> Column:
    end = recv_sec.cast("bigint") * 1_000_000 - (uptime_ms.cast("bigint") - finish_ms.cast("bigint")) * 1000
    start = end - (finish_ms.cast("bigint") - start_ms.cast("bigint")) * 1000
    return F.when(start >= 0, start)


def protocol_number(name: Column) -> Column:
    """A protocol's number from its name or digits."""
    out = F.lower(F.trim(name)).try_cast("int")
    for k, v in PROTOCOL_NUMBERS.items():
        out = F.when(F.lower(F.trim(name)) == k, v).otherwise(out)
    return out


def proto_key(protocol: Column) -> Column:
    """E13."""
    out = F.lit("other")
    for k, v in PROTOCOL_KEYS.items():
        out = F.when(protocol == k, v).otherwise(out)
    return out


def service_key(src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """By either port, in this order of precedence."""
    either = lambda *ports: src_port.isin(*ports) | dst_port.isin(*ports)
    return (
        F.when(either(443), F.when(protocol == 17, "quic").otherwise("https"))
        .when(either(80, 8080), "http")
        .when(either(53), "dns")
        .when(either(22), "ssh")
        .otherwise("svc")
    )


def direction(src_home: Column, dst_home: Column) -> Column:
    """E15; a missing home mark is false."""
    s, d = F.coalesce(src_home, F.lit(False)), F.coalesce(dst_home, F.lit(False))
    return F.when(s & d, "internal").when(s, "out").when(d, "in").otherwise("transit")


def app_or_service(app: Column, service: Column) -> Column:
    """E21's label."""
    return F.coalesce(app, service)


def geo_confidence(n: Column, dirty: Column) -> Column:
    """A13 for places."""
    return F.least(F.lit(0.99), 1.0 - 1.0 / (1.0 + n)) * F.when(dirty, F.lit(0.4)).otherwise(F.lit(1.0))


def app_confidence(n: Column, distinct_app: Column) -> Column:
    """A13 for applications."""
    return F.least(F.lit(0.95), 1.0 - 1.0 / (1.0 + n)) / distinct_app


def relocation_confidence(idx: Column, hop_count: Column) -> Column:
    """A13 for relocations."""
    return F.least(F.lit(0.85), F.lit(0.55) + F.lit(0.30) * (idx.cast("double") / F.greatest(hop_count, F.lit(1))))
