"""8. Token-ID / binary output: length-delimited binary records with masked checksums and a separate offset index.

A data file is a row of records: length of the data (unsigned 64-bit, little-endian), masked crc32 of these 8 bytes
(32-bit), the data, masked crc32 of the data. The data are one byte, the bytes an id takes (2 or 4: 2 where all ids of
the vocabulary are below 65536), and the ids as unsigned little-endian integers of that size. Its index file has 24 bytes a record: doc_id, byte
offset of the record, number of ids. Readers that shuffle seek by the index; readers that stream need the data only.

Cases: null text is an empty text (one record with the end id); empty table: no files, no rows; repeated rows: one
record each, in no fixed order among equal ids; null doc_id: sorts first, is kept apart by the index's null mark;
other columns are left behind. A damaged record raises ValueError.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.common import checkpointed, new_folder, text_bytes
from flowlake.llm.tokens import crc32_ids, encoder, vocabulary_path

#: A data file is closed beyond this size, so the driver's manifest stays small and a lost reader repeats little.
FILE_BYTES = 256 << 20
#: Text of a range of doc_ids that one task encodes, about.
PART_BYTES = 128 << 20
#: Index mark for a null doc_id.
NULL_ID = -(2**63)
_MASK_DELTA = 0xA282EAD8
_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u8")])
_MANIFEST = "first_id long, part int, number int, file string, records long, tokens long"


def arrow_uri(uri: str) -> str:
    """A folder's name as Arrow knows it: Hadoop's several names of S3 are one scheme there."""
    return re.sub("^s3[an]://", "s3://", uri)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder as Spark names it."""
    return fs.FileSystem.from_uri(arrow_uri(uri))


def masked_crc(data: bytes) -> int:
    """crc32 rotated right by 15 bits plus a constant, so a checksum of data that hold checksums stays meaningful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(ids: np.ndarray, width: int = 4) -> bytes:
    data = bytes([width]) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked_crc(head)), data, struct.pack("<I", masked_crc(data))))


def unframe(read) -> Iterator[np.ndarray]:
    """Records of an open binary file, each checked; ``read(n)`` gives the next n bytes."""
    while head := read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
            raise ValueError("a record's length is damaged")
        data = read(struct.unpack("<Q", head[:8])[0])
        tail = read(4)
        if len(tail) < 4 or struct.unpack("<I", tail)[0] != masked_crc(data):
            raise ValueError("a record's data are damaged")
        yield np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype("<u4")


class _Writer:
    """Data and index file of one task attempt; names differ for each attempt, so a repeated task harms nothing."""

    def __init__(self, folder: str, part: int, number: int, width: int):
        self.width = width
        self.files, path = file_system(folder)
        self.files.create_dir(path, recursive=True)
        self.part, self.number = part, number
        self.file = f"{path}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}"
        self.data = self.files.open_output_stream(self.file + ".rec")
        self.index: list[tuple[int, int, int]] = []
        self.bytes = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        record = frame(ids, self.width)
        self.index.append((NULL_ID if doc_id is None else doc_id, self.bytes, len(ids)))
        self.data.write(record)
        self.bytes += len(record)
        self.tokens += len(ids)

    def close(self) -> tuple:
        self.data.close()
        with self.files.open_output_stream(self.file + ".idx") as out:
            out.write(np.array(self.index, dtype=_INDEX).tobytes())
        return self.index[0][0], self.part, self.number, self.file, len(self.index), self.tokens


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encodes docs(doc_id, text) in ascending doc_id order into files in ``folder``; returns the manifest of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, writer, done = TaskContext.get().partitionId(), 0, None, []
        tokenizer, end = encoder(vocabulary), np.array([end_id], dtype="<u4")
        encode, width = tokenizer.encode_many, 2 if max(tokenizer.size, end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for doc_id, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist())):
                    if writer is None:
                        writer, number = _Writer(folder, part, number, width), number + 1
                    writer.add(doc_id, np.concatenate([ids, end]))
                    if writer.bytes >= FILE_BYTES:
                        done, writer = [*done, writer.close()], None
        if writer is not None:
            done.append(writer.close())
        names = [f.split()[0] for f in _MANIFEST.split(", ")]
        yield pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], pa.string() if n == "file" else pa.int32() if n in ("part", "number") else pa.int64()) for i, n in enumerate(names)})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(slim) // PART_BYTES)
    # rows of one doc_id, or without one, may be cut apart anywhere
    tie = F.monotonically_increasing_id()
    ordered = slim.withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id").select("doc_id", "text")
    return checkpointed(ordered.mapInArrow(write, _MANIFEST))


def read_records(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids of each record, read from the files with their index.

    The driver holds one row for each file (FILE_BYTES each), never one for each document.
    """
    files = sorted(manifest.collect(), key=lambda r: (r["part"], r["number"]))
    rows, base = [], 0
    for r in files:
        rows.append((r["file"], base))
        base += r["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, _ = file_system(folder)
                with where.open_input_stream(file + ".idx") as f:
                    index = np.frombuffer(f.read(), dtype=_INDEX)
                starts = start + np.cumsum(index["n_tokens"].astype(np.int64)) - index["n_tokens"].astype(np.int64)
                with where.open_input_stream(file + ".rec", buffer_size=1 << 20) as f:
                    records = unframe(f.read)
                    for at in range(0, len(index), 1000):
                        part = index[at : at + 1000]
                        ids = [next(records) for _ in range(len(part))]
                        if [len(i) for i in ids] != part["n_tokens"].tolist():
                            raise ValueError("index and data differ")
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(part["doc_id"], mask=part["doc_id"] == NULL_ID),
                                pa.array(starts[at : at + 1000]),
                                pa.array([i.tobytes() for i in ids], pa.binary()),
                            ],
                            names=["doc_id", "start", "ids"],
                        )

    plan = spark.createDataFrame(rows, "file string, base long")
    if rows:
        plan = plan.repartition(min(len(rows), 4096))
    return plan.mapInArrow(read, "doc_id long, start long, ids binary")


def digest(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was read back."""
    return records.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def encode_and_read(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    folder = new_folder(spark, "records")
    manifest = write_records(docs, folder, vocabulary or vocabulary_path(), end_id)
    return digest(read_records(spark, manifest, folder))
