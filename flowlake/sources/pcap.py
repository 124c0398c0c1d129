"""S3: packet captures to the server names of TLS ClientHellos.

Captures are read through binaryFile and decoded in Arrow batches. Both byte orders and both time units; Ethernet (with
one VLAN tag), raw IP and loopback frames; IPv4 and IPv6 over TCP; a hello within one segment. Anything malformed gives
no row. Nanosecond captures are read in nanoseconds.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts_us long, src_addr string, src_port int, dst_addr string, dst_port int, sni string"
# Fixed values of the formats: magic -> (byte order, fractions of a second); link types; ethertypes; TLS codes.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
LOOPBACK, ETHERNET, RAW_IP = 0, 1, 101
VLAN, IPV4, IPV6, TCP = 0x8100, 0x0800, 0x86DD, 6
HANDSHAKE, CLIENT_HELLO, SERVER_NAME, HOST_NAME = 0x16, 0x01, 0x0000, 0


def packets(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, link type, frame) of a capture's bytes; a cut last packet is left out."""
    if len(data) < 24 or data[:4] not in MAGIC:
        return
    order, unit = MAGIC[data[:4]]
    link = struct.unpack_from(order + "I", data, 20)[0]
    at = 24
    while at + 16 <= len(data):
        sec, frac, kept, _ = struct.unpack_from(order + "IIII", data, at)
        frame = data[at + 16 : at + 16 + kept]
        if len(frame) < kept:
            return
        yield sec * 10**6 + frac * 10**6 // unit, link, frame
        at += 16 + kept


def ip_packet(link: int, frame: bytes) -> bytes:
    """The IP packet of a frame; empty for other frames."""
    if link == RAW_IP:
        return frame
    if link == LOOPBACK:
        return frame[4:]
    if link != ETHERNET or len(frame) < 18:
        return b""
    kind, at = struct.unpack_from(">H", frame, 12)[0], 14
    if kind == VLAN:
        kind, at = struct.unpack_from(">H", frame, 16)[0], 18
    return frame[at:] if kind in (IPV4, IPV6) else b""


def tcp_segment(packet: bytes) -> tuple[str, int, str, int, bytes] | None:
    """(source, port, destination, port, payload) of a TCP packet."""
    if len(packet) < 20:
        return None
    if packet[0] >> 4 == 4:
        head = (packet[0] & 15) * 4
        if head < 20 or packet[9] != TCP:
            return None
        ends = packet[12:16], packet[16:20]
    elif packet[0] >> 4 == 6:
        head = 40
        if len(packet) < head or packet[6] != TCP:
            return None
        ends = packet[8:24], packet[24:40]
    else:
        return None
    tcp = packet[head:]
    if len(tcp) < 20:
        return None
    sport, dport = struct.unpack_from(">HH", tcp)
    src, dst = (str(ipaddress.ip_address(e)) for e in ends)
    return src, sport, dst, dport, tcp[(tcp[12] >> 4) * 4 :]


def vector(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    """A TLS vector: its bytes after a length of ``size`` bytes, and where it ends; IndexError where it is cut."""
    begin = at + size
    end = begin + int.from_bytes(data[at:begin], "big")
    if end > len(data) or begin > len(data):
        raise IndexError
    return data[begin:end], end


def server_name(payload: bytes) -> str | None:
    """The lower-cased first host name of a ClientHello that lies whole in one TLS record's first segment."""
    if len(payload) < 44 or payload[0] != HANDSHAKE or payload[5] != CLIENT_HELLO:
        return None
    try:
        at = 5 + 4 + 2 + 32  # record header, handshake header, version, random
        for size in (1, 2, 1):  # session, cipher suites, compression
            _, at = vector(payload, at, size)
        at += 2
        while at + 4 <= len(payload):
            kind = int.from_bytes(payload[at : at + 2], "big")
            body, at = vector(payload, at + 2, 2)
            if kind == SERVER_NAME:
                place = 2
                while place + 3 <= len(body):
                    sort = body[place]
                    name, place = vector(body, place + 1, 2)
                    if sort == HOST_NAME and 0 < len(name) <= 253 and all(33 <= c <= 126 for c in name):
                        return name.decode("ascii").lower()
                return None
    except IndexError:
        return None
    return None


def packets_to_sni(captures: DataFrame) -> DataFrame:
    """captures(content, ...) -> ts_us, src_addr, src_port, dst_addr, dst_port, sni."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("ts_us", pa.int64()), ("src_addr", pa.string()), ("src_port", pa.int32()), ("dst_addr", pa.string()), ("dst_port", pa.int32()), ("sni", pa.string())])
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for ts, link, frame in packets(content or b""):
                    seg = tcp_segment(ip_packet(link, frame))
                    if seg and (name := server_name(seg[4])):
                        rows.append(dict(zip(kinds.names, (ts, *seg[:4], name))))
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return captures.select("content").mapInArrow(run, SCHEMA)


#: Larger captures are an error: a capture is one task, and its bytes lie in memory whole.
MOST_BYTES = 512 << 20


def read_pcap(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Server names of the captures of a path; ValueError where one has more than ``most`` bytes (rotate to stay below)."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > most).select("path").limit(1).collect()
    if large:
        raise ValueError(f"capture too large: {large[0]['path']} has more than {most} bytes")
    return packets_to_sni(files)
