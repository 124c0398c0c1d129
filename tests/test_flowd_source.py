"""Flow logs cut into pieces and tailed, against decoding them whole."""

import os
import random
import struct

import pytest

from flowlake.sources import flowd, flowd_source

LAYOUTS = ((1, 2, 5, 7, 11, 12, 13), (1, 2, 6, 8, 11, 12, 13, 18), (0,), (), (1, 30))


def record(rng, n):
    bits = LAYOUTS[rng.randrange(len(LAYOUTS))]
    mask = sum(1 << b for b in bits)
    body = bytes(rng.choice((0x60, 0, rng.randrange(256))) for _ in range(flowd_source.payload_bytes(mask)))
    return struct.pack(">BBxxI", flowd.VERSION, len(body) // 4, mask) + body


def log(seed, n):
    rng = random.Random(seed)
    return b"".join(record(rng, i) for i in range(n))


def whole(data):
    """Rows and the error of a file decoded in one go."""
    rows, error = [], None
    try:
        for r in flowd.records(data):
            rows.append(r)
    except flowd.FlowdError as e:
        error = str(e)
    return rows, error


def key(rows):
    return sorted(repr(sorted((k, str(v)) for k, v in r.items() if v is not None)) for r in rows)


DAMAGES = {
    "whole": lambda d: d,
    "empty": lambda d: b"",
    "short_tail": lambda d: d + b"\x60\x01\x00",
    "cut": lambda d: d + struct.pack(">BBxxI", 0x60, 1, 1),
    "bad_version": lambda d: d[: d.index(d[40_000:40_004], 40_000)] + b"\x61" * 64 + d[40_064:],
    "bad_mask": lambda d: d + struct.pack(">BBxxI", 0x60, 2, 1) + b"12345678" + d,
}


@pytest.mark.parametrize("piece", [2048, 1 << 20])
def test_pieces_equal_the_whole(spark, tmp_path, piece):
    for i, (name, damage) in enumerate(DAMAGES.items()):
        (tmp_path / f"{name}.flowd").write_bytes(damage(log(i, 1500)))
    rows = flowd_source.read_flowd_pieces(spark, str(tmp_path), piece=piece)
    assert rows.rdd.getNumPartitions() >= (20 if piece == 2048 else 4)
    got = {}
    for r in rows.collect():
        got.setdefault(os.path.basename(r["file"]), []).append(r.asDict())
    for name in DAMAGES:
        want, error = whole((tmp_path / f"{name}.flowd").read_bytes())
        own = got.get(f"{name}.flowd", [])
        assert [r["error"] for r in own if r["error"]] == ([error] if error else [])
        assert key({**r, "file": None, "error": None} for r in own if not r["error"]) == key(want)


def test_the_format_reads_the_same(spark, tmp_path):
    (tmp_path / "a.flowd").write_bytes(log(1, 700))
    (tmp_path / "b.flowd").write_bytes(DAMAGES["cut"](log(2, 300)))
    flowd_source.register(spark)
    frame = spark.read.format("flowd").option("piece", 4096).load(str(tmp_path))
    assert frame.rdd.getNumPartitions() > 5
    rows = [r.asDict() for r in frame.collect()]
    assert sum(bool(r["error"]) for r in rows) == 1
    want = whole(log(1, 700))[0] + whole(log(2, 300))[0]
    assert key({**r, "file": None} for r in rows if not r["error"]) == key(want)


def test_a_growing_log_is_tailed_across_restarts(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()
    data = log(5, 900)
    flowd_source.register(spark)
    for upto in (0, 10_001, 10_001, 30_003, len(data)):
        (source / "log").write_bytes(data[:upto])
        stream = spark.readStream.format("flowd").option("piece", 4096).load(str(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = [r.asDict() for r in spark.read.schema(flowd_source.SCHEMA).parquet(out).collect()]
    assert key({**r, "file": None} for r in rows) == key(whole(data)[0])


def test_chains_from_every_place_agree_with_the_true_one():
    data = log(9, 800)
    borders, at = [], 0
    while at < len(data):
        borders.append(at)
        at += 8 + 4 * data[at + 1]
    borders.append(len(data))
    for first, last in ((0, 4096), (4096, 8192), (8192, 8192 + 2000), (len(data) // 8 * 4, len(data))):
        ends, bad = flowd_source.exits(data[first : last + flowd_source.RECORD], first, last, len(data))
        for b in borders:
            if first <= b < min(last, first + flowd_source.RECORD):
                assert ends[(b - first) // 4] == next(x for x in borders if x >= last) and not bad[(b - first) // 4]
