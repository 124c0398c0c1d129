"""The numbered operators against brute force, and on null, empty, long, tied and repeated rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.llm import decontam, fingerprint, langid, ngram_join, packing, quality, records, sharding, tokens, toxicity, url_filter
from flowlake.llm.hashing import words_of

SCHEMA = "doc_id long, text string, lang string, shard string, score string, n string, v long, _key string, Part string"


def word_list(seed, n, size=40):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edge_rows():
    long = " ".join(word_list(1, 30_000, 5000))
    base = " ".join(word_list(2, 60, 500))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "ONE two"), (7, long), (8, long + " tail"), (9, base), (10, base), (10, base), (None, base + " x"), (11, "ünï çode 日本語 \U0001f600 end"), (12, base.replace("w1", "q1"))]
    return [(i, t, "en", "s", "9", "n", 7, "k", "p") for i, t in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def near_docs(n, seed, width=60):
    """Families of texts with a few changed words, so similarities lie around 0.9."""
    rng = random.Random(seed)
    docs = []
    for f in range(6):
        base = [f"f{f}_{rng.randrange(10**6)}" for _ in range(width)]
        for _ in range(n // 6):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(words))
    return list(enumerate(docs, 100))


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute_components(docs):
    sets = [(i, shingles(t, 3)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 90 * len(a | b):
            x, y = top(i), top(j)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets}


@pytest.mark.parametrize("block", [1024, 8])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = near_docs(90, 5) + near_docs(30, 6, 12) + [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "a b c"), (6, "a")]
    docs = [(i + 1000 * k, t) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df).collect()}
    assert got == brute_components(docs)


def test_ngram_join_edges(edge, none):
    rows = ngram_join.link_components(edge).collect()
    assert len(rows) == 14
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert by[6]["component_id"] == 5 and by[10]["component_id"] == 9 and by[8]["component_id"] == 7
    assert ngram_join.link_components(none).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_ngram_join_of_rows_without_or_with_repeated_ids(spark, parts):
    near = near_docs(12, 3)
    texts = [(i, f"family {i} " + t) for i, t in near]
    rows = [(None, "a a a"), (5, "a a a"), (None, "b b b"), (9, "b b b"), (None, "c c c"), (None, "c c c"), (None, "d"), (None, None)]
    # one id with two texts, each with a partner of its own
    rows += [(20, "e e e"), (21, "e e e"), (20, "f f f"), (22, "f f f")]
    # rows without id in several families of near copies
    rows += [(None if k % 2 else i, t) for k, (i, t) in enumerate(near)] + [(None, t) for _, t in texts]
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    linked = {k: c for k, (_, c) in brute_components(numbered).items()}
    want = []
    for k, (i, t) in enumerate(rows):
        ids = [rows[j][0] for j, c in linked.items() if c == linked[k] and rows[j][0] is not None]
        want.append((i, len(shingles(t, 3)), min(ids, default=None)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = [tuple(r) for r in ngram_join.link_components(df).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(want)


def cluster(n, words, changed, seed):
    """Near copies of one text, each with some words changed: most link to some other, none to all."""
    rng = random.Random(seed)
    base = [f"c{seed}_{k}" for k in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changed)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [4096, 20])
def test_ngram_join_of_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = cluster(90, 150, 6, 1) + cluster(40, 200, 40, 2) + ["exact copy of a text " * 9] * 50 + [f"{t} tail" for t in cluster(6, 60, 3, 3) for _ in range(2)]
    # a passage that all share, but not enough of it to link
    texts += [" ".join(["shared", "words", "of", "many"] * 5 + [f"own{i}_{k}" for k in range(40)]) for i in range(60)]
    docs = list(enumerate(texts, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df).collect()}
    assert got == brute_components(docs)


def test_ngram_join_sends_few_pairs_of_long_near_copies(spark, monkeypatch):
    sent = []
    verify = ngram_join.verify

    def counted(docs, pairs, width, percent):
        sent.append(pairs.count())
        return verify(docs, pairs, width, percent)

    monkeypatch.setattr(ngram_join, "verify", counted)
    docs = list(enumerate(cluster(40, 5_200, 60, 4)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df).collect()}
    assert got == brute_components(docs)
    assert sum(sent) < 200  # of 780


def groups_with_the_same_prefix():
    """Sets of one size whose first shingles are the same: many groups of several members."""
    rng = random.Random(7)
    base = [f"g{k}" for k in range(60)]
    out = []
    for _ in range(40):
        own = list(base)
        for at in rng.sample(range(60), rng.choice([1, 1, 2])):
            own[at] = f"g{rng.randrange(60)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_ngram_join_expands_groups(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = list(enumerate(groups_with_the_same_prefix(), 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for width, percent in ((3, 90), (1, 80)):
        sets = {i: shingles(t, width) for i, t in docs}
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(df, width, percent / 100).collect()}
        up = {i: i for i in sets}
        for _ in sets:
            for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
                if 100 * len(a & b) >= percent * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
        assert got == up


def twins(n=2048):
    """Two words that hashes by powers of one number cannot tell apart."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    a, b = twins()
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(df).collect()} == {1: 1, 2: 2, 3: 1}
    encoder = tokens.RunEncoder(tokens.vocabulary_path())
    texts = [a, b, f"{a} end", *(w[:64] for w in (a, b)), *(w[:24] for w in (a, b))]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_many(texts)] == [expected_ids(t, 0)[:-1] for t in texts]


def test_runs_are_compared_byte_by_byte(monkeypatch):
    monkeypatch.setattr(tokens, "range_hashes", lambda data, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    encoder = tokens.RunEncoder(tokens.vocabulary_path())
    texts = ["one", "two", "one two", "onee", "a longer run of words", "internationalisation", "internationalisations"]
    assert [x.tolist() for x in encoder.encode_many(texts)] == [expected_ids(t, 0)[:-1] for t in texts]


def test_ngram_hashes_follow_words():
    grams = words_of([b"a b c d", b"", b"a b", b"x a b c"]).ngrams(3)
    assert np.diff(grams.bounds).tolist() == [2, 0, 1, 2]
    assert grams.of(0)[0] == grams.of(3)[1] and len(set(grams.hashes.tolist())) == 4


def test_fingerprints(spark, edge, none):
    docs = [(i, t) for i, t in near_docs(60, 9)] + [(500, None), (501, ""), (502, "short"), (503, "ab" * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(df).collect()}
    ids = sorted(rows)
    text = {i: t or "" for i, t in docs}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        half = len(text[a]) // 2
        edited = text[a][: len(text[a]) - half] + text[b][:half]
        assert rows[a]["n_chars"] == len(text[a])
        assert rows[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sa, sb, se = (shingles(t, 5) for t in (text[a], text[b], edited))
        true = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert rows[a]["near_edited"] == pytest.approx(true(sa, se)) and rows[a]["near_next"] == pytest.approx(true(sa, sb))  # sketches this small are whole
    assert fingerprint.fingerprint_edits(edge).count() == 14
    one = fingerprint.fingerprint_edits(edge.where("doc_id = 11")).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprint.fingerprint_edits(none).count() == 0


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(10**9)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    k = fingerprint.SKETCH_SIZE
    r = row.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(r["j"] - 1 / 3) < 4 * (0.22 / k) ** 0.5 and abs(r["c"] - 0.5) < 0.25 and abs(r["n"] / 3996 - 1) < 4 / k**0.5
    parts = row.select(F.lit(1).alias("key"), F.explode(F.array("a", "b")).alias("s"))
    merged = fingerprint.merge_parts(parts, "key", "s").first()["s"]
    both = row.select(fingerprint.merge(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert merged == both


def test_sharding_is_even_and_gapless(spark, edge, none):
    hot = "same text " * 30
    docs = [(i, hot if i % 3 == 0 else " ".join(word_list(i, 5 + i % 90))) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = sharding.shard(df, 10).select("shard", "slot", sharding.size_of(F.col("text")).alias("size")).collect()
    total = sum(r["size"] for r in rows)
    for s in range(10):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 10) <= max(r["size"] for r in rows)
    out = sharding.shard(edge, 40)
    assert out.count() == 14 and {"lang", "score", "_key"} <= set(out.columns)
    assert sharding.shard(none, 40).count() == 0


def test_sharding_cuts_equal_rows(spark, monkeypatch):
    df = spark.createDataFrame([(7, "same text", "x")] * 400, "doc_id long, text string, _lo string").repartition(5)
    rows = sharding.shard(df, 10).collect()
    for s in range(10):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(40))
    # hot keys that no border cuts, numbered in parts
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    docs = [(7, "same text")] * 400 + [(None, "b c d")] * 37 + [(None, None)] * 5 + [(i, f"t {i} " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = sharding.shard(df, 9).collect()
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in rows) == sorted((repr(i), repr(t)) for i, t in docs)
    size = lambda t: len((t or "").encode()) + 16
    total = sum(size(t) for _, t in docs)
    for s in range(9):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(size(r["text"]) for r in own) - total / 9) <= max(size(t) for _, t in docs)


def test_splitters_are_those_of_a_sort(spark):
    rng = random.Random(4)
    keys = [(rng.randrange(10**30), rng.randrange(20, 4000)) for _ in range(2000)] + [(10**29, 50)] * 300
    df = spark.createDataFrame([(str(k), s) for k, s in keys], "key string, size long").select(F.col("key").cast("decimal(38,0)").alias("key"), "size")
    order, total = sorted(keys), sum(s for _, s in keys)
    found = sharding.find_splitters(df, 12, tolerance=0.0)
    assert len(found) == 11
    for i, (key, place) in enumerate(found, 1):
        before = sum(s for k, s in keys if k < key) + place * 50
        near = min(abs(sum(s for _, s in order[:n]) - total * i // 12) for n in range(len(order) + 1))
        assert abs(before - total * i // 12) == near


def test_op4_columns(spark, tmp_path):
    from flowlake.llm import queries

    docs = [(1, "abc é"), (2, None), (3, ""), (None, "x" * 50)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_sharding(spark, str(tmp_path)).collect()
    raw = {i: (t or "").encode() for i, t in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {i: (len(b) + 16, zlib.crc32(b), "bytes", None) for i, b in raw.items()}


URLS = ["http://M.Example.org/es/1", "https://example.org/en/12?x", "https://example.org/en/2", "http://a.example.com/de/5#t", "ftp://b.com/fr/", "http://c.net/x", "nothing", None, "http://example.org", "://org/", "http://notexample.org/es/1", "x://y.org/a://b/c", ""]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[1:]) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("part_rows, shard_keys", [(url_filter.PART_ROWS, url_filter.SHARD_KEYS), (2, 3)])
def test_url_rules(spark, monkeypatch, part_rows, shard_keys):
    monkeypatch.setattr(url_filter, "PART_ROWS", part_rows)
    monkeypatch.setattr(url_filter, "SHARD_KEYS", shard_keys)
    pages = [(i, u, "h") for i, u in enumerate([*URLS * 2, *["http://hot.com/de/"] * 40, "http://x.com/" + "de/" * 50_000])]
    df = spark.createDataFrame(pages, "page_id long, url string, h1 string").withColumns({n: F.lit(n) for n in ("h2", "listed", "host", "Path", "rule", "verdict", "shard", "part", "_parts", "page", "level", "bits")})
    rows = url_filter.judge(df).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == {i: brute_rule(u) for i, u, _ in pages}
    assert all(r["listed_"] == (r["verdict"] == "block") and r["listed"] == "listed" for r in rows)  # an input column keeps its name
    assert url_filter.judge(df.limit(0)).count() == 0


def test_verdicts_come_from_the_cascade(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a.com/de/"), (2, "http://a.com/fr/")], "page_id long, url string")
    verdicts = lambda: {r["page_id"]: r["verdict"] for r in url_filter.judge(df).collect()}
    assert verdicts() == {1: "block", 2: "allow"}
    monkeypatch.setattr(url_filter, "build_cascade", lambda h1, h2, listed: [])
    assert verdicts() == {1: "allow", 2: "allow"}


def test_many_rules(spark):
    rules = [("block" if i % 2 else "allow", f"h{i}.net", f"/{'p' * (i % 5)}") for i in range(100_000)]
    pages = [(i, f"https://www.h{i}.net/pppp{i}") for i in range(0, 100_000, 997)] + [(-1, "https://h7.net.org/pp"), (-2, "https://h99999.net/")]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()
    want = {i: (f"h{i}.net/{'p' * (i % 5)}", "block" if i % 2 else "allow") for i, _ in pages if i >= 0} | {-1: (None, "allow"), -2: (None, "allow")}
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == want


def test_cascade_is_exact():
    rng = np.random.default_rng(4)
    h1, h2 = rng.integers(0, 2**63, 20_000, dtype=np.uint64), rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    for share in (0.0, 0.001, 0.3, 0.9, 1.0):
        listed = rng.random(20_000) < share
        levels = [{"shard": 0, "level": k, "hashes": n, "size": m, "bits": b} for k, n, m, b in url_filter.build_cascade(h1, h2, listed)]
        assert (url_filter.Cascades.of(levels, 1).has(np.zeros(20_000, dtype=np.int64), h1, h2) == listed).all()


def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        toxic, good = int(i % 5 == 0), int(i % 4 != 1)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["grobian", "grobling", "schuft"]))
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_words_not_copies(spark, edge, none):
    docs, labels = labelled(spark)
    rows = toxicity.score_documents(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert rows and all(r["predicted"] == r["toxic"] for r in rows)
    lexicon = toxicity.train(docs, labels)
    scorer = toxicity.Scorer(lexicon)
    plain, negated, directed, said = scorer.scores(["he is schuft", "he is not a schuft", "you are schuft", "they claimed he is schuft"])
    assert directed > plain > 0.3 > negated and said < plain
    assert scorer.scores([None, "", "...", "nothing here"]).tolist() == [0, 0, 0, 0]
    assert toxicity.score(edge, lexicon).count() == 14 and toxicity.score(none, lexicon).count() == 0
    empty = toxicity.train(docs, labels.limit(0))
    assert len(empty.strong) == 0 and toxicity.score(docs, empty).where("predicted = 1").count() == 0


def test_threat_words_alone_reject_no_long_text(spark):
    scorer = toxicity.Scorer(toxicity.Lexicon(np.sort(toxicity.word_hashes(["schuft"]).view(np.int64)), np.array([], dtype=np.int64)))
    plain = "the river was calm and the harvest good . "
    bare, softened = "fires burn and storms destroy barns . ", "it did not hurt . police said a hunter may shoot . "
    long = plain * 3000
    texts = [bare * 2, softened * 2, long + (bare + softened + plain) * 2000, (bare + softened) * 500 + " he is not a schuft", bare * 2000 + " he is a schuft", long + " you will burn . "]
    assert (scorer.scores(texts) >= toxicity.THRESHOLD).tolist() == [False] * 4 + [True] * 2
    one, negated, said = scorer.scores(["storms destroy", "no storms destroy", "police said storms destroy"])
    assert one > negated > 0 and one > said > 0
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rejected = toxicity.score(df, scorer.lexicon).where("predicted = 1").select("doc_id").collect()
    assert {r["doc_id"] for r in rejected} == {4, 5}


def test_signs_of_any_alphabet_stand_apart_from_words():
    scorer = toxicity.Scorer(toxicity.Lexicon(toxicity.word_hashes(["idiota"]).view(np.int64), np.array([], dtype=np.int64)))
    plain, *others = scorer.scores(["eres idiota", "¡idiota!", "“idiota”", "eres —idiota—", "idiota… siempre", "idiota。then"])
    assert plain > toxicity.THRESHOLD and all(x == plain for x in others)
    behind, before, far, denied = scorer.scores(["idiota tú", "tú idiota", "idiota, and then tú", "no idiota tú"])
    assert behind == before > plain and far == plain and denied < toxicity.THRESHOLD


def plain_score(text, insults):
    """The grammar, word by word, without tables or hashes."""
    import regex

    total = faint = 0.0
    for clause in regex.split(r"[.!?;\n…。！？]", (text or "").lower()):
        words = regex.findall(r"[\p{L}\p{M}\p{N}]+", clause)
        kinds = [next((k for k, w in (("insult", insults), ("threat", toxicity.THREAT_WORDS), ("report", toxicity.REPORT_WORDS), ("negation", toxicity.NEGATION_WORDS), ("target", toxicity.TARGET_WORDS)) if word in w), "") for word in words]
        if "insult" not in kinds and "threat" not in kinds:
            continue
        for i, kind in enumerate(kinds):
            if kind not in ("insult", "threat"):
                continue
            soft = "negation" in kinds[max(0, i - 3) : i] or "report" in kinds[max(0, i - 6) : i]
            near = "target" in kinds[max(0, i - 4) : i] + kinds[i + 1 : i + 3]
            if kind == "insult":
                total += 0.3 if soft else 1.8 if near else 1.2
            elif soft or not near:
                faint += 0.03 if soft else 0.1
            else:
                total += 1.0
    return 1 - np.exp(-total - min(faint, toxicity.FAINT_MOST))


def test_scores_equal_a_plain_reading_of_the_grammar():
    rng = random.Random(12)
    insults = ["schuft", "idiota"]
    vocabulary = insults * 2 + ["you", "tú", "not", "said", "kill", "hurt", "river", "house", "día", ".", "…", ",", "¡", "\n"] + ["calm"] * 4
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, ""]
    scorer = toxicity.Scorer(toxicity.Lexicon(np.sort(toxicity.word_hashes(insults).view(np.int64)), np.array([], dtype=np.int64)))
    assert scorer.scores(texts).tolist() == pytest.approx([plain_score(t, insults) for t in texts])


def test_samples_are_bounded(spark):
    from flowlake.llm.training import labelled_sample

    docs = [(i % 50, f"text {i % 50} {i % 3}") for i in range(3000)] + [(None, "null")] * 9
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    rows = labelled_sample(df, labels, "toxic", F.lit(True), 1000).collect()
    assert sorted((r["doc_id"], r["label"]) for r in rows) == [(i, i % 2) for i in range(50)]
    few = labelled_sample(df, labels, "toxic", F.lit(True), 10).count()
    assert 0 < few < 30
    # shares below one in a million still draw by hash
    from flowlake.llm.training import drawn

    hashes = spark.range(0, 1_000_000).select(F.xxhash64("id").alias("h"))
    n = [hashes.where(drawn(F.col("h"), F.lit(share))).count() for share in (1.0, 0.01, 5e-6, 0.0)]
    assert n[0] == 1_000_000 and 9_000 < n[1] < 11_000 and 0 < n[2] < 20 and n[3] == 0


def test_grammar_composes():
    follow, weight = toxicity.grammar()
    run = lambda s: sum(w for w, _ in _walk(follow, weight, s))
    assert run([toxicity.INSULT]) == pytest.approx(1.2)
    assert run([toxicity.NEGATION, toxicity.OTHER, toxicity.INSULT]) == pytest.approx(0.3)
    assert run([toxicity.NEGATION] + [toxicity.OTHER] * 4 + [toxicity.INSULT]) == pytest.approx(1.2)
    assert run([toxicity.TARGET, toxicity.THREAT]) == pytest.approx(1.0)


def _walk(follow, weight, symbols):
    state = 0
    for s in symbols:
        yield weight[state][s], state
        state = follow[state][s]


def test_language(spark, edge, none):
    rng = random.Random(2)
    en, de = "the and of that with from this are was".split(), "der die und ist nicht mit auf eine sich".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(30)), "en" if i % 2 else "de") for i in range(200)] + [(900, None, "en"), (901, "123 !!", "de"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify_documents(docs).collect()}
    assert all(got[i]["lang_pred"] == lang for i, t, lang in rows[:200])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[5]["held_out"] == (zlib.crc32(b"5") % 4 == 2)
    profiles = langid.train(docs)
    assert langid.identify(edge, profiles).count() == 14 and langid.identify(none, profiles).count() == 0
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_language_ranking_equals_plain_counting():
    codes, counts = langid.grams("Abba, ab!")
    text = " abba ab "
    plain = {}
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            g = text[i : i + n]
            if g.strip():
                key = 0
                for c in g:
                    key = key << 21 | ord(c)
                plain[key] = plain.get(key, 0) + 1
    assert dict(zip(codes.tolist(), counts.tolist())) == plain
    assert langid.ranking(codes, counts, 5).tolist() == sorted(plain, key=lambda k: (-plain[k], k))[:5]


def test_language_is_the_nearest_profile(spark):
    rng = random.Random(5)
    words = {"en": "the and of that with from this".split(), "de": "der die und ist nicht mit".split(), "es": "el que los una con por".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(["en", "de", "es"] * 30)] + [(None, "der und", "de"), (None, "el que", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def ranked(text):
        text = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        counts = {}
        for n in (1, 2, 3):
            for i in range(len(text) - n + 1):
                if text[i : i + n].strip():
                    counts[text[i : i + n]] = counts.get(text[i : i + n], 0) + 1
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))][: langid.PROFILE]

    profiles = langid.train(docs)
    for r in langid.identify(docs, profiles).collect():
        own = ranked(r["text"])
        away = {lang: sum(abs(p.index(g) - k) if g in p else langid.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}
        assert r["lang_pred"] == min(sorted(away), key=away.get)
    tied = langid.Classifier({"b": profiles["en"], "a": profiles["en"]})
    assert tied.judge("the and of") == ("a", 0.5)


def test_quality_scores_are_sparse_dot_products(spark):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=2**quality.BITS).astype(np.float32)
    texts = ["a b a c", "", None, "Don't!! stop", "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score(df, weights).collect():
        words = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", r["text"] or "")
        places = quality.features([r["text"]])[0]
        # one word is a pair of its own
        grams = len(set(words)) + len({tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set())
        assert places[0] == 0 and len(places) == grams + 1
        x = np.full(len(places), 1 / np.sqrt(max(1, len(places) - 1)))
        x[0] = 1.0
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-float((weights[places] * x).sum()))), abs=1e-5)


def test_quality(spark, edge, none):
    docs, labels = labelled(spark)
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert rows and sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    weights = quality.train(docs, labels)
    assert quality.score(edge, weights).count() == 14 and quality.score(none, weights).count() == 0
    blind = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, blind).select("score").distinct().collect()} == {0.5}


ODD = ["don't It's Σ", "e\u0301 ½ ² a\x1cb", "<|endoftext|> x", "ab12 ... ÉCOLE ß", "a×b ÷", "日本語 text"]


def library():
    return tokens.encoder(tokens.vocabulary_path()).tokenizer


def expected_ids(text, end):
    return [*library().encode(text or "", add_special_tokens=False).ids, end]


def test_cached_encoding_is_the_librarys():
    texts = ODD + [r[1] for r in edge_rows()]
    encoder = tokens.encoder(tokens.vocabulary_path())
    for _ in range(2):
        for t, ids in zip(texts, encoder.encode_many(texts)):
            assert ids.tolist() == expected_ids(t, 0)[:-1]


def test_records_round_trip(spark, edge, none, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 2000)
    rows = records.encode_and_read(spark, edge).collect()
    text = sorted(((i is not None, i or 0), t or "") for i, t, *_ in edge_rows())
    start = 0
    for r, (_, t) in zip(sorted(rows, key=lambda r: r["start"]), text):
        ids = expected_ids(t, 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert records.encode_and_read(spark, none).count() == 0


def test_folders_of_object_stores():
    assert [records.arrow_uri(f"{s}://bucket/folder") for s in ("s3a", "s3n", "s3")] == ["s3://bucket/folder"] * 3
    assert records.arrow_uri("hdfs://host/s3a://x") == "hdfs://host/s3a://x"
    assert records.file_system("file:///tmp/x")[1] == "/tmp/x"


def test_damaged_records_are_noticed():
    import io

    good = records.frame(np.array([5, 70000, 7]), 4) + records.frame(np.array([1]), 2)
    assert [r.tolist() for r in records.unframe(io.BytesIO(good).read)] == [[5, 70000, 7], [1]]
    for at in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.unframe(io.BytesIO(bytes(bad)).read))


def brute_hits(docs, items):
    norm = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for item, t in items:
        w = norm(t)
        n = min(5, len(w))
        own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for doc, text in docs:
            d = norm(text)
            have = {tuple(d[i : i + n]) for i in range(len(d) - n + 1)} or ({tuple(d)} if d and n == 5 else set())
            if own and len(own & have) * 10 >= len(own) * 8:
                out.add((doc, item, len(own & have), len(own)))
    return out


def test_decontamination(spark, edge, none):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{rng.randrange(2000)}" for _ in range(rng.choice([3, 6, 15, 40])))) for i in range(30)] + [(98, None), (99, "")]
    docs = []
    for i in range(60):
        words = word_list(i, 300, 3000)
        if i % 2:
            part = items[i % 30][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(300)
            words[at:at] = [w.upper() + "," for w in part]
        docs.append((i, " ".join(words)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matched"], r["n_shingles"]) for r in decontam.contaminated(a, b).collect()}
    assert got == brute_hits(docs, items) and got
    assert decontam.contaminated(edge, b).count() == 0 and decontam.contaminated(none, b).count() == 0
    assert decontam.contaminated(a, b.limit(0)).count() == 0


def test_documents_probe_only_partitions_within_reach(spark):
    items = [(1, " ".join(f"s{k}" for k in range(8)))] + [(100 + i, " ".join(f"l{i}x{k}" for k in range(120))) for i in range(20)]
    b = spark.createDataFrame(items, "item_id long, text string")
    shingled = decontam.item_shingles(decontam.keyed(b, *decontam.ITEM))
    _, limits, _ = decontam.partitions(shingled)
    (small, own), (large, most) = sorted(limits[5])
    assert (small, large) == (2, 6)
    docs = spark.createDataFrame([(1, " ".join(f"d{k}" for k in range(40))), (2, " ".join(f"e{k}" for k in range(4000)))], "doc_id long, text string")
    keyed = decontam.keyed(docs, *decontam.DOC)
    probed = {i: (decontam.document_hashes(keyed, [5], {5: [(small, -(2**62)), (large, 2**62)]}).where(F.col("doc_id") == i).agg(F.count("*"), F.max("h"), F.max("reach")).first()) for i in (1, 2)}
    # 36 shingles can hold no item of 64 or more: only the first limit counts
    assert probed[1][0] < 25 and probed[1][1] <= -(2**62) and probed[1][2] == small
    assert probed[2][0] > 2500 and probed[2][2] == large
    found = decontam.contaminated(docs.union(spark.createDataFrame([(3, "x y " + items[0][1])], "doc_id long, text string")), b).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(3, 1)]


def test_decontamination_of_rows_without_ids(spark):
    items = [(1, "p1 p2 p3 p4 p5 p6 p7"), (None, "q1 q2 q3 q4 q5 q6"), (None, "r1 r2 r3 r4 r5 r6 r7 r8")]
    docs = [(None, "x " + items[0][1]), (None, "clean words only here now"), (None, items[1][1] + " y"), (7, items[2][1]), (8, "p1 p2 p3 p4 p5"), (None, "r1 r2 r3 r4 r5 r6"), (None, "r5 r6 r7 r8 z")]
    docs += [(30, "p1 p2 p3 p4 p5 p6"), (30, "p3 p4 p5 p6 p7 z")]  # rows of one doc_id are one document, as in the SQL
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(repr, map(tuple, decontam.contaminated(a, b).select("doc_id", "item_id", "matched", "n_shingles").collect())))
    assert got == sorted(map(repr, [(None, 1, 3, 3), (None, None, 2, 2), (7, None, 4, 4), (30, 1, 3, 3)]))
    left = {tuple(r) for r in decontam.without_items(a, b).collect()}
    assert left == set(docs) - {docs[0], docs[2], docs[3], docs[7], docs[8]}


def check_packing(rows, docs, capacity):
    where = {}
    for r in rows:
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in where.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(where)


def test_packing(spark, edge, none):
    rows = packing.pack_documents(spark, edge).collect()
    n = check_packing(rows, edge, packing.CAPACITY)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // packing.CAPACITY) + 1
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for i, t, *_ in edge_rows():
        ids = expected_ids(t, 1)
        for k, s in enumerate(range(0, len(ids), 4096)):
            piece = np.array(ids[s : s + 4096], dtype="<u4")
            want.append(((i is not None, i or 0), k, s, len(piece), zlib.crc32(piece.tobytes())))
    assert got == sorted(want)
    assert packing.pack_documents(spark, none).count() == 0


def test_packing_plans_use_every_piece_once():
    rng = random.Random(1)
    for capacity in (10, 64):
        counts = {n: rng.randrange(50) for n in range(1, capacity + 1)}
        patterns = packing.plan_patterns(counts, capacity)
        used = {}
        for lengths, times in patterns:
            assert 0 < sum(lengths) <= capacity and times > 0
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == {n: c for n, c in counts.items() if c}
        total = sum(n * c for n, c in counts.items())
        assert sum(t for _, t in patterns) <= -(-total // capacity) * 1.25 + 1
    assert packing.plan_patterns({6: 2, 3: 2, 1: 2}, 10) == [((6, 3, 1), 2)]


def fewest_bins(lengths, capacity):
    """The optimum, by trying everything."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in sorted(set(range(len(bins))), key=lambda k: bins[k]):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_packing_plans_are_near_the_optimum():
    rng = random.Random(3)
    worse = 0
    for _ in range(150):
        lengths = sorted((rng.randrange(1, 11) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = {n: lengths.count(n) for n in lengths}
        more = sum(t for _, t in packing.plan_patterns(counts, 10)) - fewest_bins(lengths, 10)
        assert more in (0, 1)
        worse += more
    assert worse <= 7


@pytest.mark.parametrize("kind", ["few", "many", "lognormal", "short", "long"])
def test_packing_plans_are_never_above_best_fit(kind):
    rng = np.random.default_rng(4)
    lengths = np.arange(1, 4097)
    counts = {
        "few": lambda: dict(zip(lengths.tolist(), rng.integers(0, 10, 4096).tolist())),
        "many": lambda: dict(zip(lengths.tolist(), rng.integers(0, 10**6, 4096).tolist())),
        "lognormal": lambda: dict(zip(*(x.tolist() for x in np.unique(np.minimum(4096, rng.lognormal(7.6, 0.5, 20_000).astype(int) + 1), return_counts=True)))),
        "short": lambda: dict(zip(range(1, 200), rng.integers(0, 1000, 199).tolist())),
        "long": lambda: dict(zip(range(1300, 2100), rng.integers(0, 100, 800).tolist())),
    }[kind]()
    plan, alone = packing.plan_patterns(counts), packing._plan(counts, packing.CAPACITY, ())
    used = {}
    for pattern, times in plan:
        assert sum(pattern) <= packing.CAPACITY and times > 0
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == {n: c for n, c in counts.items() if c}
    assert sum(t for _, t in plan) <= sum(t for _, t in alone)


def test_packing_ranks_a_common_length_in_many_slots(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 7)
    pieces = spark.createDataFrame([(i // 3, i % 3, 5 if i % 4 else 3) for i in range(600)] + [(None, 0, 5)] * 40, "doc_id long, piece int, length long").repartition(4)
    rows = packing.pack(pieces, 10).collect()
    # 490 fives fill 245 sequences, 150 threes 50 more
    assert len(rows) == 640 and check_packing(rows, None, 10) == 295


def test_a_hot_list_of_unlinked_rows_is_compared_once(spark, monkeypatch):
    """Template texts that share most of their shingles but link to nothing: each pair of a list stands in one block."""
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    lists = spark.createDataFrame([(7, i) for i in range(200)], "token long, v long")
    labels = spark.createDataFrame([(i, 0 if i < 30 else i) for i in range(200)], "id long, component long")
    classes = spark.createDataFrame([(i, i, i, i, 100, bytes(64), None) for i in range(200)], "v long, row long, d1 long, d2 long, n int, bitmap binary, wide binary")
    dealt = ngram_join.member_lists(lists, labels, classes).collect()
    blocks = {}
    for r in dealt:
        blocks.setdefault(r["block"], []).append((r["v"], r["side"], r["component"]))
    assert max(map(len, blocks.values())) <= 2 * ngram_join.BLOCK
    met = {}
    for own in blocks.values():
        for (a, sa, ca), (b, sb, cb) in itertools.combinations(own, 2):
            if sa < 0 or sa != sb:
                met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    wanted = {(a, b) for a, b in itertools.combinations(range(200), 2) if not (a < 30 and b < 30)}
    assert set(met) == wanted and set(met.values()) == {1}
    assert sum(met.values()) <= 200 * 200 / 2


@pytest.mark.parametrize("block", [1024, 20])
def test_ngram_join_of_templates(spark, monkeypatch, block):
    """A template that many texts share, with a few that do link, small and large blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(12)
    base = [f"t{rng.randrange(10**6)}" for _ in range(90)]
    docs = []
    for i in range(130):
        words = list(base)
        for at in (range(8) if i % 3 else range(i % 2)):
            words[10 * at + 3] = f"x{i}_{at}"
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(frame).collect()}
    assert got == brute_components(docs)


def test_the_last_turn_hands_each_pair_on_once(spark, monkeypatch):
    """Near copies share many lists, and each of these handed on all of their pairs."""
    monkeypatch.setattr(ngram_join, "FIRST_LISTS", 3)
    own = {v: {t for t in range(12) if (v * 7 + t) % 5} for v in range(60)} | {60: {90, 91, 92, 11}, 61: {80, 81, 82, 11}}
    lists = spark.createDataFrame([(t, v) for v, tokens in own.items() for t in tokens], "token long, v long")
    labels = spark.createDataFrame([(v, v % 40) for v in range(62)], "id long, component long")
    classes = spark.createDataFrame([(v, v, v, v, 100, bytes(64), None) for v in range(62)], "v long, row long, d1 long, d2 long, n int, bitmap binary, wide binary")
    found = ngram_join.list_pairs(ngram_join.member_lists(lists, labels, classes, True), 90, 2, True).collect()
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in found]
    wanted = {(a, b) for a, b in itertools.combinations(range(62), 2) if own[a] & own[b] and a % 40 != b % 40}
    # a pair whose first lists have none in common is not lost
    assert set(pairs) == wanted and (60, 61) in wanted
    known = [p for p in pairs if set(sorted(own[p[0]])[:3]) & set(sorted(own[p[1]])[:3])]
    assert len(known) == len(set(known)) and len(known) > 1000
