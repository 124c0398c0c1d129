"""5. URL filters: rules by host and path, compiled into Bloom filter cascades over the corpus's own keys.

A rule fits its host and all subdomains, if the url's path starts with the rule's; the longest rule wins. The key
universe is every distinct (host, path) of the pages; listed are the keys that a block rule judges. A cascade's even
levels encode listed keys, its odd levels those unlisted keys that passed all levels before, and so on until no key of
the universe is mistaken; so membership is exact for every page, and the cascade alone gives its verdict: listed is block.
Keys are dealt to shards by hash, each with a cascade of bounded size. Pages are dealt by shard, those of a shard in parts
of bounded size, and a part reads its cascade before its pages: no page is joined with a list at any size.

Rules are looked up by host suffix and path beginning, so their number matters little; they name the rule of a page and
tell once a key, when the cascades are built, what is listed.

Cases: null urls and urls without ``://`` have empty host and path and fit no rule; urls no rule fits are not listed:
allow; repeated rows are judged each; an empty table gives no rows; other columns are kept, result columns replaced.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import checkpointed, free_name
from flowlake.llm.hashing import mix

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: About so many distinct keys share a cascade.
SHARD_KEYS = 100_000
#: Pages of a shard that share one reading of its cascade.
PART_ROWS = 200_000
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LEVELS = "shard long, level int, hashes int, size long, bits binary"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class RuleBook:
    """Rules by host, and for each host by path; of rules with the same host and path the last counts."""

    def __init__(self, rules):
        self.paths: dict[str, dict[str, str]] = {}
        for verdict, host, path in rules:
            self.paths.setdefault(host, {})[path] = verdict
        self.lengths = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.paths.items()}

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits; of two of one length the last in order."""
        best = None
        at = 0
        while True:
            own = host[at:]
            for n in self.lengths.get(own, ()):
                if n <= len(path) and (verdict := self.paths[own].get(path[:n])) is not None:
                    best = max(best or (0, "", ""), (len(own) + n, own + path[:n], verdict))
                    break
            dot = host.find(".", at)
            if dot < 0:
                return best[1:] if best else (None, None)
            at = dot + 1


def rule_of(rules=RULES):
    """A function of host and path columns: struct(rule, verdict), both null where no rule fits."""
    book = RuleBook(rules)

    @F.pandas_udf("rule string, verdict string")
    def look(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([book.find(h, p) for h, p in zip(host, path)], columns=["rule", "verdict"], dtype=object)

    return look


def _places(h1: np.ndarray, h2: np.ndarray, level: int, i: int, size) -> np.ndarray:
    return mix(h1 + np.uint64(i) * h2 + np.uint64(level * 1_000_003)) % size


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(level, hashes, bits, bytes) of the cascade that tells listed from unlisted keys exactly; none if none is listed."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels = []
    while len(inside):
        level = len(levels)
        rate = min(0.5, max(1e-6, len(inside) * math.sqrt(0.5) / max(1, len(outside)))) if level == 0 else 0.5
        hashes = max(1, round(-math.log2(rate)))
        size = max(64, 8 * math.ceil(len(inside) * -math.log(rate) / math.log(2) ** 2 / 8))
        bits = np.zeros(size, dtype=np.uint8)
        for i in range(hashes):
            bits[_places(h1[inside], h2[inside], level, i, np.uint64(size)).astype(np.int64)] = 1
        levels.append((level, hashes, size, np.packbits(bits).tobytes()))
        passed = np.ones(len(outside), dtype=bool)
        for i in range(hashes):
            passed &= bits[_places(h1[outside], h2[outside], level, i, np.uint64(size)).astype(np.int64)] == 1
        inside, outside = outside[passed], inside
    return levels


@dataclass
class Cascades:
    """All shards' cascades as flat tables; ``has`` looks up many keys at once."""

    size: np.ndarray  # (shards, levels), 0 where a shard has no such level
    begin: np.ndarray
    hashes: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(rows: list, shards: int) -> "Cascades":
        depth = max((r["level"] + 1 for r in rows), default=0)
        size, begin, hashes = (np.zeros((shards, depth + 1), dtype=np.int64) for _ in range(3))
        at = 0
        for r in rows:
            size[r["shard"], r["level"]], begin[r["shard"], r["level"]], hashes[r["shard"], r["level"]] = r["size"], at, r["hashes"]
            at += len(r["bits"])
        return Cascades(size, begin, hashes, np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), dtype=np.uint8))

    def has(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(h1), dtype=bool)
        left = np.arange(len(h1))
        for level in range(self.size.shape[1]):
            s = shard[left]
            ends = self.size[s, level] == 0  # passed the last level: it holds what that level encodes
            listed[left[ends]] = level % 2 == 1
            left, s = left[~ends], s[~ends]
            if len(left) == 0:
                break
            size, begin, hashes = self.size[s, level], self.begin[s, level], self.hashes[s, level]
            passed = np.ones(len(left), dtype=bool)
            for i in range(int(hashes.max())):
                p = _places(h1[left], h2[left], level, i, size.astype(np.uint64)).astype(np.int64)
                hit = (self.bits[begin + p // 8] >> (7 - p % 8).astype(np.uint8)) & 1
                passed &= (hit == 1) | (i >= hashes)
            listed[left[~passed]] = level % 2 == 1
            left = left[passed]
        return listed


def _hashes(host: Column, path: Column) -> list[Column]:
    return [F.xxhash64(host, path).alias("h1"), F.xxhash64(path, F.lit("/"), host).alias("h2")]


def cascades(keys: DataFrame, shards: int) -> DataFrame:
    """The cascades of keys(h1, h2, listed), distinct, by shard."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (part[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("h1", "h2"))
        levels = build_cascade(h1, h2, part["listed"].to_numpy(dtype=bool))
        return pd.DataFrame([(int(part["shard"].iloc[0]), *x) for x in levels], columns=["shard", "level", "hashes", "size", "bits"])

    return keys.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, _LEVELS)


def listed_pages(pages: DataFrame, built: DataFrame, shards: int, h1: str, h2: str, listed: str) -> DataFrame:
    """pages plus ``listed``: what the cascade of their shard says of (h1, h2)."""
    names = [*pages.columns, listed]
    shard = free_name(pages, "shard")
    rows = pages.withColumn(shard, F.pmod(h1, F.lit(shards)))
    # shards with pages for several parts: fewer rows than there are parts of PART_ROWS pages, so they fit every task
    parts = rows.groupBy(shard).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.broadcast(checkpointed(parts.select(F.col(shard).alias("_shard"), "_parts")))
    many = lambda df, own: df.join(parts, df[own] == F.col("_shard"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = many(rows.select(shard, F.struct(*pages.columns).alias("page")), shard)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "_parts").cast("int"))
    empty = lambda kind: F.lit(None).cast(kind)
    left = many(built, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "level", "hashes", "size", "bits", empty(dealt.schema["page"].dataType).alias("page"))
    right = dealt.select(F.col(shard).alias("shard"), "part", empty("int").alias("level"), empty("int").alias("hashes"), empty("long").alias("size"), empty("binary").alias("bits"), "page")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels, own = None, [], None
        for b in batches:
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else []
            for i, j in zip(first, [*first[1:], len(key)]):
                if (now := tuple(key[i].tolist())) != at:
                    at, levels, own = now, [], None
                some = b.slice(i, j - i)
                cascade = some.filter(some.column(2).is_valid())
                levels += [r | {"shard": 0} for r in cascade.select(["level", "hashes", "size", "bits"]).to_pylist()]
                these = some.filter(some.column(2).is_null()).column(6)
                if len(these) == 0:
                    continue
                own = own or Cascades.of(levels, 1)
                columns = dict(zip(names, these.flatten()))
                x, y = (columns[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in (h1, h2))
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(own.has(np.zeros(len(x), dtype=np.int64), x, y))], names=names)

    both = left.unionByName(right).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("level").asc_nulls_last())
    return both.mapInArrow(look, pages.withColumn(listed, F.lit(True)).schema)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages plus host, path, rule, verdict, and listed (with underscores where a column has that name)."""
    pages = pages.drop("host", "path", "rule", "verdict")
    h1, h2, listed = (free_name(pages, n) for n in ("h1", "h2", "listed"))
    url = F.col("url").cast("string")
    find = rule_of(rules)
    rows = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    hashes = _hashes(F.col("host"), F.col("path"))
    rows = rows.withColumn(h1, hashes[0]).withColumn(h2, hashes[1])
    keys = rows.select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), "host", "path").distinct()
    keys = keys.select("h1", "h2", F.coalesce(find("host", "path")["verdict"] == "block", F.lit(False)).alias("listed"))
    keys = checkpointed(keys)
    shards = max(1, keys.count() // SHARD_KEYS)
    rows = listed_pages(rows, checkpointed(cascades(keys, shards)), shards, h1, h2, listed)
    verdict = F.when(F.col(listed), "block").otherwise("allow")
    return rows.select(*pages.columns, "host", "path", find("host", "path")["rule"].alias("rule"), verdict.alias("verdict"), listed)
