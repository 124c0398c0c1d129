"""Schemas of records and state tables."""

FLOW_RECORD = (
    "tag long, recv_sec long, recv_usec long, tcp_flags int, protocol int, tos int, agent_addr string, src_addr string, "
    "dst_addr string, gateway_addr string, src_port int, dst_port int, packets decimal(20,0), octets decimal(20,0), if_index_in long, "
    "if_index_out long, sys_uptime_ms long, agent_time_sec long, agent_time_nanosec long, netflow_version int, "
    "flow_start long, flow_finish long, src_as long, dst_as long, src_mask int, dst_mask int, engine_type int, "
    "engine_id int, flow_sequence long, source_id long, crc32 long"
)
GEO_POINT = "struct<lat: double, lon: double, country: string, city: string, is_home: boolean>"
IP_GEO = (
    "ip string, lat double, lon double, country string, source string, obs_count long, confidence double, dirty boolean, "
    "first_seen long, last_seen long, corr_lat double, corr_lon double, corr_source string, corr_conf double, corr_rtt_ms double, corr_anchor_ip string"
)
GEO_DECISIONS = (
    "ip string, reason string, old_lat double, old_lon double, old_source string, new_lat double, new_lon double, "
    "new_source string, obs_count long, confidence double, notes string"
)
IP_APP = (
    "ip string, app string, category string, sni string, obs_count long, distinct_sni long, confidence double, source string, "
    "first_seen long, last_seen long"
)
APP_DECISIONS = "ip string, sni string, app string, category string, confidence double, reason string, notes string"
HOPS = "array<struct<idx: int, ip: string, lat: double, lon: double, country: string, rtt_ms: double>>"
