"""Addresses as canonical text: numbers, prefix tests and address classes, all as JVM-side expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Address ranges of the three private predicates and of the reserved classes, in order of precedence.
LOCAL = "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 127.0.0.0/8 169.254.0.0/16 255.255.255.255/32 0.0.0.0/8 224.0.0.0/4 100.64.0.0/10 ::1/128 ::/128 ff00::/8 fc00::/7 fe80::/10".split()
PRIVATE_OBSERVED = "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 127.0.0.0/8 169.254.0.0/16 100.64.0.0/10 224.0.0.0/4 255.255.255.255/32 fc00::/7 fe80::/10 ff00::/8 ::1/128".split()
PRIVATE_HISTORY = "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 127.0.0.0/8 169.254.0.0/16 100.64.0.0/10 224.0.0.0/4 fc00::/7 fe80::/10 ff00::/8".split()
BOGONS = (
    ("0.0.0.0/8", '"this" network'),
    ("10.0.0.0/8", "private-use"),
    ("172.16.0.0/12", "private-use"),
    ("192.168.0.0/16", "private-use"),
    ("100.64.0.0/10", "carrier-grade NAT"),
    ("127.0.0.0/8", "loopback"),
    ("169.254.0.0/16", "link-local"),
    ("192.0.0.0/24", "IETF protocol assignments"),
    ("192.0.2.0/24", "TEST-NET-1"),
    ("198.18.0.0/15", "benchmark testing"),
    ("198.51.100.0/24", "TEST-NET-2"),
    ("203.0.113.0/24", "TEST-NET-3"),
    ("224.0.0.0/4", "multicast"),
    ("240.0.0.0/4", "future use"),
    ("::/128", "node-scope unspecified"),
    ("::1/128", "node-scope loopback"),
    ("::ffff:0.0.0.0/96", "IPv4-mapped"),
    ("::/96", "IPv4-compatible"),
    ("100::/64", "remotely triggered black hole"),
    ("2001:10::/28", "ORCHID"),
    ("2001:db8::/32", "documentation prefix"),
    ("3fff::/20", "documentation prefix"),
    ("fc00::/7", "ULA"),
    ("fe80::/10", "link-local unicast"),
    ("fec0::/10", "site-local unicast"),
    ("ff00::/8", "multicast v6"),
)


@F.pandas_udf(StringType())
def canonical_ip(text: pd.Series) -> pd.Series:
    """Canonical text of an address, null where it is none; needed once, where addresses enter."""

    def one(t):
        try:
            return None if t is None else str(ipaddress.ip_address(t.strip()))
        except ValueError:
            return None

    known = {t: one(t) for t in text.unique()}
    return text.map(known)


def ip_number(ip: Column) -> Column:
    """An IPv4 text as a number; null for anything else."""
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint")
    number = part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4)
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def ip6_hex(ip: Column) -> Column:
    """A canonical IPv6 text as 32 hexadecimal digits; null for anything else."""
    # a trailing dotted quad is two more groups
    quad = F.regexp_extract(ip, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    number = ip_number(quad)
    groups = F.concat(F.hex(F.shiftright(number, 16)), F.lit(":"), F.hex(number.bitwiseAND(65535)))
    text = F.when(quad == "", ip).otherwise(F.concat(F.regexp_replace(ip, r"\d+\.\d+\.\d+\.\d+$", ""), groups))
    sides = F.split(text, "::", -1)
    fill = lambda c: F.transform(F.filter(F.split(c, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    head, tail = fill(F.get(sides, 0)), fill(F.coalesce(F.get(sides, 1), F.lit("")))
    gap = F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), F.lit(8) - F.size(head) - F.size(tail)))
    return F.when(ip.contains(":"), F.array_join(F.concat(head, gap, tail), ""))


def _once(ip: Column, use) -> Column:
    """``use(number, hex)`` with both forms of the address computed once a row."""
    forms = F.array(F.struct(ip_number(ip).alias("n"), F.when(ip.contains(":"), ip6_hex(ip)).alias("h")))
    return F.element_at(F.transform(forms, lambda x: use(x["n"], x["h"])), 1)


def _within(number: Column, hexed: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr)
    if net.version == 4:
        return F.coalesce(number.between(int(net.network_address), int(net.broadcast_address)), F.lit(False))
    whole, rest = divmod(net.prefixlen, 4)
    digits = f"{int(net.network_address):032x}"
    within = hexed.startswith(digits[:whole])
    if rest:
        base = int(digits[whole], 16)
        within = within & F.substring(hexed, whole + 1, 1).isin([f"{d:x}" for d in range(base, base + (1 << (4 - rest)))])
    return F.coalesce(within, F.lit(False))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether a canonical address lies in a network; false for the other address family, null for a null address."""
    return in_cidrs(ip, [cidr])


def in_cidrs(ip: Column, cidrs: list[str]) -> Column:
    def any_of(number: Column, hexed: Column) -> Column:
        found = F.lit(False)
        for c in cidrs:
            found = found | _within(number, hexed, c)
        return found

    return F.when(ip.isNotNull(), _once(ip, any_of))


def is_local(ip: Column) -> Column:
    """E5: loopback, private, link-local, multicast, broadcast, shared and unspecified addresses."""
    return in_cidrs(ip, LOCAL)


def is_public(ip: Column, variant: str = "local") -> Column:
    """not in one of three ranges lists: ``local`` (E5), ``observed`` (geo pass), ``history`` (history, candidates)."""
    return ~in_cidrs(ip, {"local": LOCAL, "observed": PRIVATE_OBSERVED, "history": PRIVATE_HISTORY}[variant])


def bogon_class(ip: Column) -> Column:
    """Class of a reserved address by the first range that holds it, else null."""

    def first(number: Column, hexed: Column) -> Column:
        found = F.lit(None).cast("string")
        for cidr, name in reversed(BOGONS):
            found = F.when(_within(number, hexed, cidr), name).otherwise(found)
        return found

    return _once(ip, first)
