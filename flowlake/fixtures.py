"""Flow tables derived from the benchmark tables, as SQL that runs unchanged on Spark and DuckDB (see FIXTURES.md)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("events", "nation", "pages", "customer", "supplier", "part")

#: Peers of the flows are as many addresses as there are customers, 97 at least.
FLOWS = r"""
SELECT k AS flow_id, 1704067200000000 + k*250000 AS recv_us,
  CASE WHEN m<=4 OR m=8 THEN lan WHEN m<=7 THEN rip ELSE rip END AS src_addr,
  CASE WHEN m<=4 THEN rip WHEN m<=7 THEN (CASE WHEN ph=1 THEN '192.168.0.10' ELSE lan END) WHEN m=8 THEN '192.168.9.9' ELSE rip2 END AS dst_addr,
  CAST(CASE WHEN m BETWEEN 5 AND 7 THEN svc ELSE eph END AS INT) AS src_port,
  CAST(CASE WHEN m BETWEEN 5 AND 7 THEN eph ELSE svc END AS INT) AS dst_port,
  CAST(CASE et WHEN 'click' THEN 6 WHEN 'view' THEN 17 WHEN 'purchase' THEN 6 WHEN 'signup' THEN 1 ELSE 50 END AS INT) AS protocol,
  octets, CAST(1+floor(octets/1400.0) AS BIGINT) AS packets,
  CASE WHEN m IN (5,6,7,9) THEN 64512 + r%5 ELSE 0 END AS src_as,
  CASE WHEN m<=4 THEN 64512 + r%5 WHEN m=9 THEN 64600 ELSE 0 END AS dst_as,
  10000000 + k - (k%1000) - (k*37%60000) AS flow_start_ms, 10000000 + k - (k%1000) AS flow_finish_ms, 10000000 + k AS uptime_ms
FROM (
 SELECT e.event_id AS k, e.event_id%10 AS m, e.event_type AS et, CAST(floor(e.event_id/1000.0) AS BIGINT)%2 AS ph,
  e.event_id*7%peers AS r,
  concat('192.168.',CAST(e.user_id%4 AS STRING),'.',CAST(1+e.user_id%250 AS STRING)) AS lan,
  CASE WHEN (e.event_id*7%peers)%16=15 THEN concat('203.0.113.',CAST((e.event_id*7%peers)%250 AS STRING))
       WHEN (e.event_id*7%peers)%16=14 THEN concat('2606:4700::',CAST((e.event_id*7%peers)%9999 AS STRING))
       ELSE concat('93.',CAST((e.event_id*7%peers)%25 AS STRING),'.',CAST(CAST(floor((e.event_id*7%peers)/250.0) AS BIGINT)%250 AS STRING),'.',CAST((e.event_id*7%peers)%250 AS STRING)) END AS rip,
  concat('94.',CAST(e.event_id*11%25 AS STRING),'.0.',CAST(e.event_id*11%89 AS STRING)) AS rip2,
  CASE e.user_id%6 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 8080 ELSE 50001 END AS svc,
  49152+e.event_id%16000 AS eph,
  CASE WHEN e.event_id%50=0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(e.value*1000) AS BIGINT) + CASE WHEN e.event_id%200=1 THEN 6000000 ELSE 0 END END AS octets
 FROM events e CROSS JOIN (SELECT CASE WHEN count(*) < 97 THEN 97 ELSE count(*) END AS peers FROM customer) p) z
"""

GEO_BLOCKS = r"""
SELECT CAST(n_nationkey AS BIGINT) AS block_id, 93 AS o1, CAST(n_nationkey AS INT) AS o2,
 CAST(93*16777216 + n_nationkey*65536 AS BIGINT) AS ip_lo, CAST(93*16777216 + n_nationkey*65536 + 65535 AS BIGINT) AS ip_hi,
 CAST(CASE WHEN n_nationkey%5=0 THEN 38.0 ELSE -60+5*n_nationkey END AS DOUBLE) AS lat, CAST(CASE WHEN n_nationkey%5=0 THEN -97.0 ELSE -170+13*n_nationkey END AS DOUBLE) AS lon, n_name AS country,
 CAST(NULL AS STRING) AS hex_lo, CAST(NULL AS STRING) AS hex_hi FROM nation
UNION ALL SELECT CAST(1000 AS BIGINT), 203, 0, CAST(3405803776 AS BIGINT), CAST(3405804031 AS BIGINT), CAST(10.0 AS DOUBLE), CAST(20.0 AS DOUBLE), 'ZZ', NULL, NULL
UNION ALL SELECT CAST(1001 AS BIGINT), NULL, NULL, NULL, NULL, CAST(12.0 AS DOUBLE), CAST(34.0 AS DOUBLE), 'YY', '26064700000000000000000000000000', '26064700ffffffffffffffffffffffff'
UNION ALL SELECT CAST(1002 AS BIGINT), NULL, NULL, NULL, NULL, CAST(-12.0 AS DOUBLE), CAST(56.0 AS DOUBLE), 'XY', '26064700000000000000000000000000', '2606470000000000000000000000003f'
"""

ROUTE_HOPS = r"""
SELECT concat('93.',CAST(r%25 AS STRING),'.',CAST(CAST(floor(r/250.0) AS BIGINT)%250 AS STRING),'.',CAST(r%250 AS STRING)) AS dst_ip, 1704067200000000 + r*1000000 AS traced_us, CAST(h.idx AS INT) AS idx,
  CAST(-60+5*((r+h.idx*3)%25) AS DOUBLE) AS lat, CAST(-170+13*((r+h.idx*3)%25) AS DOUBLE) AS lon, CASE WHEN (r+h.idx)%6=0 THEN NULL ELSE CAST(h.idx*(5+r%40) AS DOUBLE) END AS rtt_ms,
  concat('93.',CAST((r+h.idx*3)%25 AS STRING),'.255.1') AS ip
 FROM (SELECT DISTINCT event_id*7%peers AS r FROM (SELECT event_id, peers FROM events CROSS JOIN (SELECT CASE WHEN count(*) < 97 THEN 97 ELSE count(*) END AS peers FROM customer) p) e) q CROSS JOIN (SELECT 1 AS idx UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) h WHERE r%16 < 14
"""

#: One place for each customer; nations are landmasses.
PLACES = r"""
SELECT c_custkey AS id, CAST((c_custkey*7919)%36000 AS DOUBLE)/100 - 180 AS lon, CAST((c_custkey*104729)%15000 AS DOUBLE)/100 - 75 AS lat, CAST(c_nationkey AS BIGINT) AS landmass, concat('c', CAST(c_custkey AS STRING)) AS name FROM customer
"""

#: One site for each supplier: cable landings and centres of small areas.
SITES = r"""
SELECT s_suppkey AS id, CAST((s_suppkey*9973)%36000 AS DOUBLE)/100 - 180 AS lon, CAST((s_suppkey*50021)%15000 AS DOUBLE)/100 - 75 AS lat FROM supplier
"""

#: Traced routes to one address for each customer, over hops that are places of other customers.
TRACES = r"""
SELECT concat('95.', CAST(CAST(floor(k/62500.0) AS BIGINT)%250 AS STRING), '.', CAST(CAST(floor(k/250.0) AS BIGINT)%250 AS STRING), '.', CAST(k%250 AS STRING)) AS dst_ip, 1704067200000000 + k*1000000 AS traced_us, idx, hop,
 CASE WHEN (k+idx)%6=0 THEN NULL ELSE CAST(idx*(5+k%40) AS DOUBLE) END AS rtt_ms, lon, lat
FROM (SELECT CAST(q.k AS BIGINT) AS k, h.idx, 1 + ((q.k%46337)*(q.k%46337)*CAST(h.f AS BIGINT) + q.k*7)%2147483647%(SELECT max(c_custkey) FROM customer) AS hop FROM (SELECT c_custkey AS k FROM customer) q
 CROSS JOIN (SELECT CAST(1 AS INT) AS idx, 48271 AS f UNION ALL SELECT CAST(2 AS INT), 69621 UNION ALL SELECT CAST(3 AS INT), 39373 UNION ALL SELECT CAST(4 AS INT), 39373) h) s
JOIN (SELECT c_custkey AS id, CAST((c_custkey*7919)%36000 AS DOUBLE)/100 - 180 AS lon, CAST((c_custkey*104729)%15000 AS DOUBLE)/100 - 75 AS lat FROM customer) p ON p.id = s.hop
"""

#: Two cable lines of four points for each supplier, four lines a system, between the places of other suppliers; every
#: twelfth system ends at the dateline and goes on behind it.
CABLES = r"""
SELECT k*2+j AS line, CAST(floor(k/2.0) AS BIGINT) AS system, i,
 CASE WHEN d AND j=0 AND i=3 THEN 179.8 WHEN d AND j=1 AND i=0 THEN -179.7 ELSE hlon + (tlon-hlon)*i/3.0 + CASE WHEN i IN (0,3) THEN ((k*31+j*17+i*7)%21-10)/50.0 ELSE 0.0 END END AS lon,
 CASE WHEN d AND j=1 AND i=0 THEN hlat0 + (k%5)/4.0 ELSE CASE WHEN d AND j=0 AND i=3 THEN hlat0 ELSE hlat + (tlat-hlat)*i/3.0 END + i*(3-i)*0.5 END AS lat
FROM (SELECT CAST(s.k AS BIGINT) AS k, CAST(v.j AS BIGINT) AS j, CAST(p.i AS INT) AS i, CAST(floor(s.k/2.0) AS BIGINT)%12=0 AS d,
  CAST((h*9973)%36000 AS DOUBLE)/100 - 180 AS hlon, CAST((h*50021)%15000 AS DOUBLE)/100 - 75 AS hlat, CAST((t*9973)%36000 AS DOUBLE)/100 - 180 AS tlon, CAST((t*50021)%15000 AS DOUBLE)/100 - 75 AS tlat,
  CAST((s.k*50021)%9000 AS DOUBLE)/100 - 45 AS hlat0
 FROM (SELECT s_suppkey AS k FROM supplier) s CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1) v CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) p
 CROSS JOIN LATERAL (SELECT 1+(s.k*7+v.j*3)%n AS h, 1+(s.k*11+v.j*5+2)%n AS t FROM (SELECT count(*) AS n FROM supplier) c) e) q
"""

SNI_LOG = r"""
SELECT page_id AS obs_id, 1704067200000000 + page_id*60000000 AS ts_us,
 concat('93.',CAST((page_id*7%peers)%25 AS STRING),'.',CAST(CAST(floor((page_id*7%peers)/250.0) AS BIGINT)%250 AS STRING),'.',CAST((page_id*7%peers)%250 AS STRING)) AS dst_addr,
 concat('192.168.0.',CAST(1+page_id%20 AS STRING)) AS src_addr, lower(regexp_extract(url,'://([^/?#]+)',1)) AS sni FROM pages CROSS JOIN (SELECT CASE WHEN count(*) < 97 THEN 97 ELSE count(*) END AS peers FROM customer) p
"""

APP_RULES = r"""
SELECT suffix, min(app) AS app, min(category) AS category FROM (
 SELECT regexp_replace(lower(regexp_extract(url,'://([^/?#]+)',1)),'^(blog|www|m)[.]','') AS suffix, concat('app',CAST(length(regexp_extract(url,'://([^/?#]+)',1))%7 AS STRING)) AS app, 'site' AS category
 FROM pages WHERE regexp_extract(url,'://([^/?#]+)',1) LIKE '%example.org' AND length(regexp_extract(url,'://([^/?#]+)',1))%2=0
 UNION ALL SELECT 'example.com','ExampleCom','cloud'
 UNION ALL SELECT 'example.org','ExampleOrg','cloud') u GROUP BY suffix
"""

FIXTURES = {"flows": FLOWS, "geo_blocks": GEO_BLOCKS, "places": PLACES, "sites": SITES, "cables": CABLES, "traces": TRACES, "route_hops": ROUTE_HOPS, "sni_log": SNI_LOG, "app_rules": APP_RULES}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet tables in ``sf_dir``."""
    sql = FIXTURES[name]
    for base in BASE_TABLES:
        sql = re.sub(rf"\b(FROM\s+){base}\b", lambda m: f"{m[1]}parquet.`{sf_dir}/{base}.parquet`", sql)
    return spark.sql(sql)


def with_fixtures(body: str, *names: str) -> str:
    """DuckDB SQL: the named derived tables as common table expressions before ``body`` (which may go on with ", x AS")."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n].strip()})" for n in names) + "\n" + body
