"""S1 for logs of any size: binary flow logs cut into pieces at record borders, in batch and as a growing stream.

Records differ in length and carry no mark to find them by, so a piece of a file cannot tell where its first record
begins. But a record is at most 1,028 bytes long and a whole number of words, so it begins at one of 257 places. Each
piece follows the chain of headers from all of these (chains from wrong places end at once or run into the right one), and
says where each leaves the piece; a file's pieces are then put together from its start. So borders are exact, and both the
scan and the decoding are tasks of one piece. Files are read in ranges through pyarrow's file systems; stores that
only Spark knows are read by ``flowd.read_flowd``, a file a task.

An error ends its file, as in ``flowd``: records behind it are not read.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from flowlake.schemas import FLOW_RECORD
from flowlake.sources import flowd

#: Bytes of a piece, of a record at most, and rows of a batch.
PIECE, RECORD, ROWS = 64 << 20, 8 + 4 * 255, 10_000
#: Bytes read at a time.
BUFFER = 4 << 20
SCHEMA = f"{FLOW_RECORD}, file string, error string"


def arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "decimal(20,0)": pa.decimal128(20, 0)}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])


def batches_of(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    kinds, held = arrow_schema(), []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=kinds)


def whole_uri(path: str) -> str:
    """Spark's short form of a local address in full."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def opened(path: str):
    """A file open for reading at any place."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(whole_uri(path)) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def listed(path: str) -> list[tuple[str, int]]:
    """Path and size of every file of a folder, or of the file itself."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(whole_uri(path)) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    infos = where.get_file_info([name])
    if infos[0].type == fs.FileType.Directory:
        infos = where.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((scheme + i.path, i.size) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))


def payload_bytes(mask: int) -> int:
    """Bytes of the fields of a mask."""
    return sum(struct.calcsize(">" + layout) for bit, layout, _ in flowd.FIELDS if mask >> bit & 1)


def follow(data: bytes, base: int, at: int, last: int, size: int, sizes: dict[int, int], marks: list[int] | None = None) -> tuple[int, bool]:
    """From a record at ``at`` along the headers: where the first record at or behind ``last`` begins, or the end of the file;
    or where the first bad record begins, and True. ``data`` are the file's bytes from ``base`` on; ``size`` its length."""
    while at < last and size - at >= 8:
        i = at - base
        words, mask = data[i + 1], int.from_bytes(data[i + 4 : i + 8], "big")
        need = sizes.get(mask)
        if need is None:
            need = sizes[mask] = payload_bytes(mask)
        if data[i] != flowd.VERSION or need != 4 * words or at + 8 + need > size:
            return at, True
        if marks is not None:
            marks.append(at)
        at += 8 + need
    return (size if size - at < 8 else at), False


def exits(data: bytes, first: int, last: int, size: int) -> tuple[list[int], list[bool]]:
    """``follow`` from every place at which a record may begin in the piece [first, last)."""
    sizes, done, out = {}, {}, []
    for at in range(first, min(first + RECORD + 4, last), 4):
        if at not in done:
            # chains meet soon or never: places near the start are remembered
            marks: list[int] = []
            near = min(last, first + 16 * RECORD)
            end = follow(data, first, at, near, size, sizes, marks)
            if not end[1] and end[0] < last:
                if end[0] not in done:
                    done[end[0]] = follow(data, first, end[0], last, size, sizes)
                end = done[end[0]]
            done |= {m: end for m in marks}
            done[at] = end
        out.append(done[at])
    return [e for e, _ in out], [bad for _, bad in out]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first, last, size in zip(*(c.to_pylist() for c in batch.columns)):
            with opened(path) as f:
                f.seek(first)
                data = f.read(min(last + RECORD, size) - first)
            ends, bad = exits(data, first, last, size)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first]), pa.array([last]), pa.array([size]), pa.array([ends], type=pa.list_(pa.int64())), pa.array([bad], type=pa.list_(pa.bool_()))], names=["path", "first", "last", "size", "ends", "bad"])


def _join(key, pieces):
    """Pieces of one file with their exact borders (Spark reads type hints here, and knows none for text)."""
    rows, at = [], 0
    for p in sorted(pieces.to_pylist(), key=lambda p: p["first"]):
        if not p["first"] <= at < p["last"]:
            continue  # the file ended, or a record covers the rest of this piece
        i = (at - p["first"]) // 4
        end, bad = p["ends"][i], p["bad"][i]
        rows.append({"path": p["path"], "first": at, "last": end, "bad": bad})
        if bad:
            break
        at = end
    return pa.Table.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("bad", pa.bool_())]))


def decoded(path: str, first: int, last: int, bad: bool, mode: str) -> Iterator[dict]:
    """Records of [first, last), which begins and ends at borders, and the error there if there is one."""
    with opened(path) as f:
        at, sizes = first, {}
        while at < last:
            f.seek(at)
            data = f.read(min(BUFFER, last - at))
            if at + len(data) < last:
                stop, _ = follow(data, at, at, at + len(data) - RECORD, last, sizes)
            else:
                stop = last
            for row in flowd.records(data[: stop - at]):
                yield {**row, "file": path}
            at = stop
        if bad:
            f.seek(last)
            try:
                list(flowd.records(f.read(2 * RECORD)))
            except flowd.FlowdError as e:
                if mode.upper() == "FAILFAST":
                    raise
                yield {"file": path, "error": str(e)}


def read_flowd_pieces(spark: SparkSession, path: str, mode: str = "PERMISSIVE", piece: int = PIECE) -> DataFrame:
    """Flow records of the files of a path, plus file and error, by tasks of about ``piece`` bytes (a whole number of words,
    above the longest record)."""
    by_value()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    pieces = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(piece).cast("long"))).alias("first"), "size")
    pieces = pieces.select("path", "first", F.least(F.col("first") + piece, "size").alias("last"), "size")
    n = max(1, pieces.count())
    scanned = pieces.repartition(n).mapInArrow(_scan, "path string, first long, last long, size long, ends array<long>, bad array<boolean>")
    exact = scanned.groupBy("path").applyInArrow(_join, "path string, first long, last long, bad boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in zip(*(c.to_pylist() for c in batch.columns)):
                yield from batches_of(decoded(*one, mode))

    return exact.repartition(n).mapInArrow(run, SCHEMA)


def by_value() -> None:
    """From now on this source's code is sent along with a task or a plan, so no worker needs the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(flowd)


def write_logs(files: DataFrame, folder: str) -> int:
    """Writes files(name, content) into a folder, each by one task, and returns their number; a file written again replaces
    itself."""
    by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(whole_uri(folder)) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                with where.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class Piece(InputPartition):
    def __init__(self, path: str, first: int, last: int, bad: bool):
        self.path, self.first, self.last, self.bad = path, first, last, bad


def cut_file(path: str, at: int, size: int, piece: int) -> list[Piece]:
    """Pieces of a file from a border on, in one pass over its headers with a bounded buffer."""
    out, start, sizes = [], at, {}
    step = min(BUFFER, max(piece, 4 * RECORD))
    with opened(path) as f:
        bad = False
        while at < size and not bad and size - at >= 8:
            f.seek(at)
            data = f.read(min(step, size - at))
            whole = at + len(data)
            # behind this place a record may go on beyond the buffer
            upto = whole if whole == size else whole - RECORD
            at, bad = follow(data, at, at, upto, size, sizes)
            if at - start >= piece:
                out.append(Piece(path, start, at, False))
                start = at
    if bad or at > start:
        out.append(Piece(path, start, at, bad))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode, self.piece = options["path"], options.get("mode", "PERMISSIVE"), int(options.get("piece", PIECE))

    def partitions(self) -> list[Piece]:
        return [p for path, size in listed(self.path) for p in cut_file(path, 0, size, self.piece)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return batches_of(decoded(piece.path, piece.first, piece.last, piece.bad, self.mode))


class _Tail(DataSourceStreamReader):
    """Offsets are the border behind the last whole record of every file; a record that is not yet written whole waits."""

    def __init__(self, options: dict):
        self.path, self.piece = options["path"], int(options.get("piece", PIECE))
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _border(self, path: str, size: int) -> int:
        pieces = cut_file(path, self.at.get(path, 0), size, 1 << 62)
        if pieces and pieces[-1].bad:
            # a record that the file's end cuts is not bad yet
            with opened(path) as f:
                f.seek(pieces[-1].last)
                head = f.read(8)
            if head[0] != flowd.VERSION or payload_bytes(int.from_bytes(head[4:8], "big")) != 4 * head[1]:
                raise flowd.FlowdError(f"bad record at byte {pieces[-1].last} of {path}")
        return pieces[-1].last if pieces else self.at.get(path, 0)

    def latestOffset(self) -> dict:
        # fewer bytes than a header at the end are no record yet
        self.at |= {path: min(self._border(path, size), size) for path, size in listed(self.path)}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [p for path, last in end.items() for p in cut_file(path, start.get(path, 0), last, self.piece)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return batches_of(decoded(piece.path, piece.first, piece.last, piece.bad, "FAILFAST"))


class FlowdSource(DataSource):
    """``spark.read.format("flowd")`` and ``spark.readStream.format("flowd")``: options path, mode and piece. Planning reads the
    headers once; a stream reads those of new records, and after a restart of all."""

    @classmethod
    def name(cls) -> str:
        return "flowd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; it is sent by value, so planning needs no installed package."""
    by_value()
    spark.dataSource.register(FlowdSource)
