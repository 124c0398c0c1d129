"""Every pipeline stage against a brute-force version on a small fixture."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlake.llm import ngram_join, packing
from test_numbered import brute_hits, check_packing, labelled, near_docs, shingles


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels = labelled(spark)
    rows = [tuple(r) for r in docs.collect()]
    more = [(1000 + i, t, "en") for i, t in near_docs(30, 4)]
    rng = random.Random(1)
    items = [(i, " ".join(f"bench{rng.randrange(500)}" for _ in range(20))) for i in range(3)]
    leaks = [(2000 + i, f"w1 w2 w3 {t} w4 w5", "en") for i, t in items]
    odd = [(3000, None, None), (3001, "", "en"), (3002, "42 !", "en")]
    all_rows = [(i, t, lang, "src", len(t or "")) for i, t, lang in rows + more + leaks + odd]
    spark.createDataFrame(all_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r["doc_id"]: r["toxic"] for r in labels.collect()}, items


def test_stages(spark, tables):
    folder, toxic, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = set(text)
    for name, expected in (
        ("toxicity", lambda ids: {i for i in ids if not toxic.get(i)}),
        ("language_id", lambda ids: {i for i in ids if any(c.isalpha() for c in text[i] or "")}),
        ("ngram_jaccard_join", lambda ids: brute_near_copies([(i, text[i]) for i in ids])),
        ("benchmark_decontamination", lambda ids: ids - {h[0] for h in brute_hits([(i, text[i]) for i in ids], items)}),
    ):
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/after_{name}")
        docs = spark.read.parquet(f"{folder}/after_{name}")
        left = expected(left)
        assert {r["doc_id"] for r in docs.collect()} == left, name
    rows = stages["best_fit_packing"](spark, docs, folder).collect()
    assert {r["doc_id"] for r in rows} == left
    check_packing(rows, docs, packing.CAPACITY)


def test_stages_of_empty_repeated_and_long_rows(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = " ".join(f"long{k % 9000}" for k in range(40_000))
    base = docs.where("doc_id < 400").unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((5000, long), (5001, long + " end"), (5002, "a repeated row"), (5002, "a repeated row"))], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    left = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, base, folder).collect()}
    assert 5000 in left and 5001 not in left and 5002 in left
    assert dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, base, folder).where("doc_id = 5002").count() == 2


def test_run_gives_the_last_stage(spark, tables):
    folder, _, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def brute_near_copies(docs, width=5, percent=80):
    """doc_ids that stay: all but those that a chain of near copies links to a smaller one."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = top(i), top(j)
            up[max(x, y)] = min(x, y)
    return {i for i in up if top(i) == i}


@pytest.mark.parametrize("block", [1024, 8])
def test_near_copies_are_of_five_words_and_eight_tenths(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(11)
    texts = [None, "", "a b c d", "A b c d", "a b c d e"]
    for f in range(8):
        base = [f"b{f}_{k}" for k in range(200)]
        texts.append(" ".join(base))
        for changed in (3, 4, 5, 6):
            words = list(base)
            for at in rng.sample(range(5, 195, 10), changed):
                words[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        for tail in (20, 24, 30, 48, 52):
            texts.append(" ".join(base + [f"t{f}_{tail}_{k}" for k in range(tail)]))
    docs = list(enumerate(texts, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == brute_near_copies(docs)
    assert kept < brute_near_copies(docs, 3, 90)


def test_bounds_hold_for_every_similarity():
    for percent in (50, 80, 90, 100):
        for a in range(1, 40):
            for b in range(a, 40):
                fit = [a + b - 2 * both for both in range(a + 1) if 100 * both >= percent * (a + b - both)]
                assert ngram_join.most_different(a, b, percent) >= max(fit, default=-1) and (not fit or ngram_join.most_different(a, b, percent) == max(fit))


def test_stages_keep_every_column_of_their_input(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 or doc_id >= 1000")
    clash = ["score", "predicted", "lang_pred", "_found", "shard", "component_id", "n_shingles", "Row", "token", "block", "item_id", "width", "_own0", "held_out"]
    more = docs
    for i, c in enumerate(clash):
        more = more.withColumn(c, F.concat(F.lit(f"{i}:"), "doc_id"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.dtypes == more.dtypes, name
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stage(spark, docs, folder).collect()}, name
        assert all(r[c] == f"{i}:{r['doc_id']}" for r in rows for i, c in enumerate(clash)), name
