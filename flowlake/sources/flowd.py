"""The ``flowd`` source: binary flow logs as flow records.

A record is an 8-byte header (version 0x60, payload length in 4-byte words, 2 bytes unused, field mask) and the masked
fields in order, big-endian. Files are read through Spark's binaryFile reader, so they may lie in any store, and
decoded in Arrow batches. Errors end their file: ``PERMISSIVE`` adds a row with ``error``, ``FAILFAST`` fails.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.schemas import FLOW_RECORD

VERSION = 0x60
# Fixed values of the format: mask bit, struct format, and the columns it fills (None: padding).
FIELDS = (
    (0, "I", ("tag",)),
    (1, "II", ("recv_sec", "recv_usec")),
    (2, "BBBx", ("tcp_flags", "protocol", "tos")),
    (3, "4s", ("agent_addr",)),
    (4, "16s", ("agent_addr",)),
    (5, "4s", ("src_addr",)),
    (6, "16s", ("src_addr",)),
    (7, "4s", ("dst_addr",)),
    (8, "16s", ("dst_addr",)),
    (9, "4s", ("gateway_addr",)),
    (10, "16s", ("gateway_addr",)),
    (11, "HH", ("src_port", "dst_port")),
    (12, "Q", ("packets",)),
    (13, "Q", ("octets",)),
    (14, "II", ("if_index_in", "if_index_out")),
    (15, "IIIHxx", ("sys_uptime_ms", "agent_time_sec", "agent_time_nanosec", "netflow_version")),
    (16, "II", ("flow_start", "flow_finish")),
    (17, "IIBBxx", ("src_as", "dst_as", "src_mask", "dst_mask")),
    (18, "HHII", ("engine_type", "engine_id", "flow_sequence", "source_id")),
    (30, "I", ("crc32",)),
)
COLUMNS = [c.split()[0] for c in FLOW_RECORD.split(", ")]


class FlowdError(ValueError):
    pass


def decode(mask: int, payload: bytes) -> dict:
    """Columns of one record's payload; its length must be exactly that of the masked fields."""
    row: dict = {}
    at = 0
    for bit, layout, names in FIELDS:
        if not mask >> bit & 1:
            continue
        size = struct.calcsize(">" + layout)
        if at + size > len(payload):
            raise FlowdError(f"truncated record: field {names[0]} ends after the payload")
        for name, value in zip(names, struct.unpack_from(">" + layout, payload, at)):
            row[name] = str(ipaddress.ip_address(value)) if isinstance(value, bytes) else value
        at += size
    if at != len(payload):
        raise FlowdError(f"payload mismatch: {len(payload)} bytes, {at} used (fields 0x{mask:08x})")
    return row


def records(data: bytes) -> Iterator[dict]:
    """Records of a file's bytes; no bytes, no records. Raises FlowdError at the first bad one."""
    at = 0
    # fewer bytes than a header are the end, as after a writer's crash
    while at + 8 <= len(data):
        version, words, mask = struct.unpack_from(">BBxxI", data, at)
        if version != VERSION:
            raise FlowdError(f"unsupported version 0x{version:02x}")
        payload = data[at + 8 : at + 8 + 4 * words]
        if len(payload) < 4 * words:
            raise FlowdError("truncated record: the file ends inside it")
        yield decode(mask, payload)
        at += 8 + 4 * words


#: Larger files are an error: a file is one task, and its bytes lie in memory whole.
MOST_BYTES = 512 << 20


def decode_files(files: DataFrame, mode: str = "PERMISSIVE", most: int = MOST_BYTES) -> DataFrame:
    """Flow records plus file and error of files(path, length, content); a file of more than ``most`` bytes gives an error
    and none of its bytes is read (rotate logs to stay below)."""
    schema = f"{FLOW_RECORD}, file string, error string"
    # the content of too large a file is never asked for
    fits = F.when(F.col("length") <= most, F.col("content"))
    kinds = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in files.sparkSession.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, file in enumerate(b.column(0).to_pylist()):
                rows = []
                content = b.column(1)[i].as_py()
                try:
                    if content is None:
                        raise FlowdError(f"file too large: more than {most} bytes")
                    for row in records(content):
                        rows.append({**row, "file": file})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows = []
                except FlowdError as e:
                    if mode.upper() == "FAILFAST":
                        raise
                    rows.append({"file": file, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", fits.alias("content")).mapInArrow(run, schema)


def read_flowd(spark: SparkSession, path: str, mode: str = "PERMISSIVE", most: int = MOST_BYTES) -> DataFrame:
    """decode_files over the files of a path."""
    small = spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("path", "length", "content")
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return decode_files(small.unionByName(large), mode, most)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "decimal(20,0)": pa.decimal128(20, 0)}[kind]
