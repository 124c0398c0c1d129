"""Mixing, hard negatives and vector codes against brute force, and on null, empty, tied and repeated rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.llm import cover_tree, hard_negatives, mixing, queries, vector_codes

# columns that clash with names used inside, whatever their case
DOCS = "doc_id long, text string, source string, size long, Target double, queue int, part int, finish string, rows int"
VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, Cell int, part int, _label int, error long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2.0, 3, 4, "f", 5) for i, t, s in rows], DOCS)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, l, "v", "c", 1, 2, 3, 4) for i, v, l in rows], VECTORS)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def brute_mix(rows, weights=(1, 2, 3), most=3):
    """The rule read plainly: sorted rows (doc_id, size, source, target, taken)."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(words(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, cut = sum(size.values()), set()
    while True:
        left = total - sum(most * size[s] for s in cut)
        unit = left / max(1, sum(weight[s] for s in sources if s not in cut))
        more = {s for s in sources if s not in cut and unit * weight[s] > most * size[s]}
        if not more:
            break
        cut |= more
    target = {s: float(most * size[s]) if s in cut else left * weight[s] / sum(weight[x] for x in sources if x not in cut) for s in sources}
    key = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    copies, taken = [], {}
    for at, s in enumerate(sources):
        own = sorted((key(i), -1 if i is None else i, words(t)) for i, t, x in rows if x == s)
        upto = 0
        for n, (k, i, w) in enumerate(own):
            upto += w
            taken[s, n] = (None if i == -1 else i, w, s, target[s], 0)
            copies += [((r * size[s] + upto) / target[s], k, i, w, at, n, r) for r in range(most) if w]
    so_far = 0
    for _, _, _, w, at, n, _ in sorted(copies):
        so_far += w
        if so_far > total:
            break
        i, w, s, t, took = taken[sources[at], n]
        taken[sources[at], n] = (i, w, s, t, took + w)
    return sorted(taken.values(), key=repr)


def mixed(df):
    return sorted(((r["doc_id"], r["size"], r["source"], r["target"], r["taken"]) for r in df.collect()), key=repr)


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(99)}" for _ in range(n))


def test_mix_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, text_of(rng, rng.choice([1, 5, 40, 300])), rng.choice(["a"] * 9 + ["b", "c", "d", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t\n", "nothing"), (1003, "one", "tiny"), (7, "x y", "a"), (7, "x y", "a"), (None, "q", "d"), (None, "q", "d"), (None, "q r", "d"), (1004, text_of(rng, 30_000), "long")]
    docs = docs_of(spark, rows)
    want = brute_mix(rows)
    assert mixed(mixing.mix(docs.repartition(3))) == want
    assert mixed(mixing.mix(docs.repartition(7))) == want
    by = {}
    for i, w, s, t, took in want:
        assert took % max(w, 1) == 0 and took <= 3 * w
        by.setdefault(s, [t, 0, 0])
        by[s][1] += took
        by[s][2] = max(by[s][2], w)
    # a source misses its target by less than its longest document, one that may be passed over included
    longest = max(x[2] for x in by.values())
    assert all(abs(t - took) <= 2 * longest for t, took, _ in by.values())
    assert sum(x[1] for x in by.values()) <= sum(w for _, w, _, _, _ in want)


@pytest.mark.parametrize("part_rows", [10, 100_000])
def test_mix_in_parts_and_its_order(spark, monkeypatch, part_rows):
    monkeypatch.setattr(mixing, "PART_ROWS", part_rows)
    rng = random.Random(4)
    rows = [(i, text_of(rng, rng.randrange(1, 30)), "ab"[i % 3 == 0]) for i in range(120)]
    docs = docs_of(spark, rows)
    assert mixed(mixing.mix(docs)) == brute_mix(rows)
    order = mixing.mixed_order(docs).collect()
    took = {}
    for r in order:
        took[r["doc_id"]] = took.get(r["doc_id"], 0) + r["size"]
    assert took == {i: t for i, _, _, _, t in brute_mix(rows) if t}
    by_time = sorted(order, key=lambda r: r["finish"])
    assert [r["range"] for r in by_time] == sorted(r["range"] for r in order)
    # at any place of the order the sources stand near their weights
    part = {s: sum(r["size"] for r in by_time[: len(by_time) // 2] if (r["doc_id"] % 3 == 0) == (s == "b")) for s in "ab"}
    target = {s: next(t for _, _, x, t, _ in brute_mix(rows) if x == s) for s in "ab"}
    assert abs(part["a"] / target["a"] - part["b"] / target["b"]) < 0.1


def test_mix_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).collect() == []
    got = mixing.mix(docs_of(spark, [(1, None, None), (2, "", "s")])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixed(mixing.mix(docs_of(spark, [(None, "a b", None)] * 5))) == brute_mix([(None, "a b", None)] * 5)


def test_shares_stop_at_three_times():
    assert mixing.share([], [], 3) == []
    assert mixing.share([10, 10], [1, 2], 3) == [20 / 3, 40 / 3]
    assert mixing.share([100, 1, 0], [1, 2, 3], 3) == [98.0, 3.0, 0.0]
    assert mixing.share([0, 0], [1, 2], 3) == [0.0, 0.0]


def clusters(rng, n, dim=8, groups=5, spread=0.1):
    centres = rng.normal(size=(groups, dim))
    v = centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


BAD = [(901, None, 1), (902, [None] + [0.5] * 7, 1), (903, [float("nan")] * 8, 2), (904, [float("inf")] + [0.0] * 7, 2), (905, [0.1] * 8, None)]


def brute_negatives(rows, every=10):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, l in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    out = []
    for a, (al, av) in anchors.items():
        score = [(-sum(x * y for x, y in zip(av, v)), i, l) for i, v, l in ok]
        for ps, p, _ in sorted(s for s in score if s[2] == al and s[1] != a)[:5]:
            fit = sorted(s for s in score if s[2] != al and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:5]
            out += [(a, p, k, i, -ps, -s) for k, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("part_rows, lane, own", [(4096, 65_536, 64), (60, 7, 8)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, part_rows, lane, own):
    monkeypatch.setattr(hard_negatives, "PART_ROWS", part_rows)
    monkeypatch.setattr(hard_negatives, "LANE", lane)
    rng = np.random.default_rng(1)
    v = np.vstack([clusters(rng, 250), clusters(rng, 150, spread=1.0), np.repeat(clusters(rng, 1), 60, axis=0), 3 * clusters(rng, 40)])
    rows = [(i, [float(x) for x in u], int(rng.integers(4))) for i, u in enumerate(v)] + BAD
    # repeated rows, an anchor that stands twice, no components, a shorter vector, one of no length, no id
    rows += [rows[5], rows[20], (20, [0.0] * 8, 0), (30, [], 1), (601, [0.5], 1), (610, [0.0] * 8, 2), (None, [0.1] * 8, 1)]
    pad = [(i, u and u + [0.0] * (8 - len(u)) if u != [] else [0.0] * 8, l) for i, u, l in rows]
    table = vectors_of(spark, rows).repartition(3)
    got = mined(hard_negatives.mine(table, F.col("label"), F.col("vec_id") % 10 == 0))
    assert got == brute_negatives(pad) and len(got) > 200


def test_hard_negatives_of_little(spark):
    mine = lambda rows: mined(hard_negatives.mine(vectors_of(spark, rows), F.col("label"), F.col("vec_id") % 10 == 0))
    assert mine([]) == [] and mine(BAD) == [] and mine([(0, [1.0], 1)]) == [] and mine([(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mine([(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]) == []
    # ties by smaller id
    assert [r[3] for r in mine([(0, [1.0], 1), (1, [1.0], 1)] + [(i, [1.0], 2) for i in range(19, 10, -1)])] == [11, 12, 13, 14, 15]


def test_forests_of_any_size_are_exact_and_skip_nodes(monkeypatch):
    rng = np.random.default_rng(2)
    v = np.floor(256 * np.vstack([clusters(rng, 3000, spread=0.05), np.repeat(clusters(rng, 1), 300, axis=0)])).astype(np.int64)
    labels, ids = rng.integers(6, size=len(v)), rng.permutation(len(v))
    most = int((v * v).sum(axis=1).max()) + 5
    forest = cover_tree.Forest.from_bytes(cover_tree.build(ids, labels, v, most).to_bytes())
    assert sorted(forest.ids.tolist()) == sorted(ids.tolist())
    looked = []
    take = cover_tree._Best.take
    monkeypatch.setattr(cover_tree._Best, "take", lambda self, s, i: (looked.append(len(s)), take(self, s, i)) and None)
    for q in v[::300]:
        s = v @ q
        for same in (True, False):
            for low, high in ((None, None), (int(s.max()) * 8 // 10, int(s.max()) - 1000), (0, 0), (10, 5)):
                fit = [(-x, i) for x, i, l in zip(s.tolist(), ids.tolist(), labels.tolist()) if (l == 3) == same and (low is None or low <= x <= high)]
                assert forest.search(q, 3, same, [(low, high)], 5) == [[(-x, i) for x, i in sorted(fit)[:5]]]
    # every node's bound holds, and most rows were never looked at
    assert sum(looked) < 0.5 * len(v) * 11 * 4


def test_forests_of_huge_integers():
    v = np.array([[2**30, 5], [-(2**30), 7], [2**30 - 1, 2**29]], dtype=np.int64)
    forest = cover_tree.build(np.arange(3), np.array([1, 1, 2]), v, int(2**60 + 25 + 2**58))
    want = sorted(((int(sum(int(x) * int(y) for x, y in zip(v[0], u))), i) for i, u in enumerate(v) if i < 2), reverse=True)
    assert forest.search(v[0], 1, True, [(None, None)], 5) == [want]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(1, *(len(v) for _, v, _ in ok), 1) // parts)
    ok = [(i, v + [0] * (width * parts - len(v)), l) for i, v, l in ok]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.array([r[1] for r in ok]).reshape(len(ok), parts, width)
    books = v[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((v[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        near = d.argmin(axis=2)
        if k < rounds:
            for p in range(parts):
                for e in set(near[:, p].tolist()):
                    own = v[near[:, p] == e, p]
                    books[p, e] = own.sum(axis=0) // len(own)
    error = d.min(axis=2).sum(axis=1)
    by = {}
    for (_, _, l), e in zip(ok, error):
        by[l] = by.get(l, 0) + int(e)
    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1)).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in n), int(e), by[l], digest) for (i, _, l), n, e in zip(ok, near, error)), key=repr)


def codes(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("labels", [100_000, 2])
def test_vector_codes_equal_brute_force(spark, monkeypatch, labels):
    monkeypatch.setattr(vector_codes, "LABELS", labels)
    monkeypatch.setattr(vector_codes, "TASK_ROWS", 200)
    rng = np.random.default_rng(5)
    v = np.vstack([clusters(rng, 500), np.repeat(clusters(rng, 1), 120, axis=0), rng.integers(-2, 3, size=(150, 8)) / 2])
    rows = [(i, [float(x) for x in u], int(rng.integers(4)) if i % 9 else None) for i, u in enumerate(v)] + BAD
    rows += [rows[3], (3, [0.25] * 8, 2), (None, [0.5] * 8, 1), (999, [], 1), (998, [0.5], None)]
    assert codes(vector_codes.compress(vectors_of(spark, rows).repartition(4))) == brute_codes(rows)


def test_vector_codes_of_little(spark):
    assert vector_codes.compress(vectors_of(spark, [])).collect() == []
    assert vector_codes.compress(vectors_of(spark, BAD[:4])).collect() == []
    for rows in ([(1, [], 1)], [(1, [0.5] * 7, 1), (2, [0.25] * 9, None)], [(5, [1.0] * 4, 1)] * 3):
        assert codes(vector_codes.compress(vectors_of(spark, rows))) == brute_codes(rows)


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(6)
    for scale, width in ((1, 1), (2, 3), (1024, 16), (2**30, 4), (2**40, 4)):
        entries = rng.integers(-scale, scale + 1, size=(200, width))
        part = np.vstack([rng.integers(-scale, scale + 1, size=(700, width)), entries[::7]])
        index, distance = vector_codes.nearest(part, entries)
        d = ((part[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
        assert distance.tolist() == d.min(axis=1).tolist() and index.tolist() == [row.tolist().index(min(row.tolist())) for row in d]


def test_new_queries_return_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    kinds = {
        "op11_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op12_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
        "op13_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    }
    for name, want in kinds.items():
        assert dict(queries.QUERIES[name](spark, sf).dtypes) == want
