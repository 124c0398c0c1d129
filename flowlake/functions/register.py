"""SQL functions of a session: geo_haversine_km, direction, ip_digits, in_cidr, bogon_class."""

from __future__ import annotations

import ipaddress

from pyspark.sql import SparkSession

from flowlake.functions.ip import BOGONS

#: The functions in the order in which they build on each other. Addresses may be in any valid form. ip_digits has 8
#: digits for IPv4 and 32 for IPv6, and is null for what is no address, so a network is a beginning of digits and the
#: high bits of the next one; of equal lengths are addresses of one family.
_FUNCTIONS = (
    "geo_haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN "
    "2 * 6371.0D * asin(least(1.0D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "direction(src_home BOOLEAN, dst_home BOOLEAN) RETURNS STRING RETURN "
    "CASE WHEN coalesce(src_home, false) AND coalesce(dst_home, false) THEN 'internal' WHEN coalesce(src_home, false) THEN 'out' WHEN coalesce(dst_home, false) THEN 'in' ELSE 'transit' END",
    "ipv4_number(ip STRING) RETURNS BIGINT RETURN "
    "CASE WHEN ip RLIKE '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$' THEN aggregate(split(ip, '[.]'), 0L, (n, p) -> n * 256 + CAST(p AS BIGINT)) END",
    # a dotted quad at the end is two groups
    "ipv6_bare(ip STRING, quad BIGINT) RETURNS STRING RETURN "
    "lower(CASE WHEN ip NOT LIKE '%.%' THEN ip ELSE concat(left(ip, length(ip) - length(substring_index(ip, ':', -1))), hex(shiftright(quad, 16)), ':', hex(quad & 65535)) END)",
    "ipv6_groups(side STRING) RETURNS ARRAY<STRING> RETURN CASE WHEN side = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(side, ':') END",
    "ipv6_filled(head ARRAY<STRING>, tail ARRAY<STRING>, gap BOOLEAN) RETURNS ARRAY<STRING> RETURN "
    "CASE WHEN gap AND size(head) + size(tail) < 8 THEN concat(head, array_repeat('0', 8 - size(head) - size(tail)), tail) WHEN NOT gap AND size(head) = 8 THEN head END",
    "ipv6_joined(parts ARRAY<STRING>) RETURNS STRING RETURN "
    "CASE WHEN forall(parts, g -> g RLIKE '^[0-9a-f]{1,4}$') THEN array_join(transform(parts, g -> lpad(g, 4, '0')), '') END",
    "ipv6_sides(sides ARRAY<STRING>) RETURNS STRING RETURN "
    "CASE WHEN size(sides) <= 2 THEN ipv6_joined(ipv6_filled(ipv6_groups(sides[0]), ipv6_groups(coalesce(get(sides, 1), '')), size(sides) = 2)) END",
    "ip_digits(ip STRING) RETURNS STRING RETURN "
    "CASE WHEN ip LIKE '%:%' THEN ipv6_sides(split(ipv6_bare(ip, ipv4_number(substring_index(ip, ':', -1))), '::', -1)) ELSE lower(lpad(hex(ipv4_number(ip)), 8, '0')) END",
    "digits_within(d STRING, net STRING, bits INT) RETURNS BOOLEAN RETURN "
    "length(d) = length(net) AND bits <= 4 * length(net) AND left(d, bits DIV 4) = left(net, bits DIV 4) "
    "AND (bits % 4 = 0 OR shiftright(CAST(conv(substr(d, bits DIV 4 + 1, 1), 16, 10) AS INT), 4 - bits % 4) = shiftright(CAST(conv(substr(net, bits DIV 4 + 1, 1), 16, 10) AS INT), 4 - bits % 4))",
    # null for a null argument; false for the other address family and for what is no address or no network; a network
    # without a length is one address
    "in_cidr(ip STRING, cidr STRING) RETURNS BOOLEAN RETURN "
    "CASE WHEN ip IS NOT NULL AND cidr IS NOT NULL THEN cidr RLIKE '^[^/]+(/[0-9]{1,3})?$' AND coalesce(digits_within(ip_digits(ip), ip_digits(split_part(cidr, '/', 1)), "
    "CASE WHEN cidr LIKE '%/%' THEN try_cast(split_part(cidr, '/', 2) AS INT) WHEN cidr LIKE '%:%' THEN 128 ELSE 32 END), false) END",
)


def _classes() -> str:
    """SQL: the class of digits d by the first range that holds them."""
    cases = []
    for cidr, name in BOGONS:
        net = ipaddress.ip_network(cidr)
        digits = net.max_prefixlen // 4
        whole, rest = divmod(net.prefixlen, 4)
        text = f"{int(net.network_address):0{digits}x}"
        test = f"length(d) = {digits} AND d LIKE '{text[:whole]}%'"
        if rest:
            low = int(text[whole], 16)
            test += f" AND substr(d, {whole + 1}, 1) BETWEEN '{low:x}' AND '{low + (1 << (4 - rest)) - 1:x}'"
        cases.append(f"WHEN {test} THEN '{name}'")
    return f"CASE {' '.join(cases)} END"


def register_functions(spark: SparkSession) -> None:
    """All are SQL expressions, which the optimizer sees through and no Python worker is needed for."""
    for text in (*_FUNCTIONS, f"digits_class(d STRING) RETURNS STRING RETURN {_classes()}", "bogon_class(ip STRING) RETURNS STRING RETURN digits_class(ip_digits(ip))"):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
