"""The numbered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import decontam, fingerprint, hard_negatives, langid, mixing, ngram_join, packing, quality, records, sharding, toxicity, url_filter, vector_codes
from flowlake.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), width=3, similarity=0.9)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_and_read(spark, table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_document_fingerprints,
        op3_toxicity,
        op4_sharding,
        op5_url_filters,
        op6_language_id,
        op7_quality_classifier,
        op8_token_records,
        op9_benchmark_decontamination,
        op10_best_fit_packing,
        op11_source_mixing,
        op12_hard_negatives,
        op13_vector_codes,
    )
}

#: Rows of the embeddings without null or non-finite components, in components times a scale, rounded down.
_WHOLE = """SELECT *, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _vector_codes_sql(rounds: int = 4) -> str:
    """Each round in full: distances to all entries, then the mean of each entry's parts."""
    near = """SELECT r, p, arg_min(i, d * 256 + i) AS i, min(d) AS d
 FROM (SELECT r, x.p, i, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v) AS d FROM x JOIN {books} b ON x.p = b.p) GROUP BY r, p"""
    moved = """SELECT b.p, b.i, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
 SELECT p, i, list(floor(total / n) ORDER BY j) AS v FROM (
  SELECT p, i, j, sum(c) AS total, count(*) AS n FROM (SELECT a.p, a.i, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS j FROM {near} a JOIN x ON a.r = x.r AND a.p = x.p) GROUP BY p, i, j) GROUP BY p, i) m ON b.p = m.p AND b.i = m.i"""
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(books=f'b{k}')})")
        steps.append(f"b{k + 1} AS MATERIALIZED ({moved.format(books=f'b{k}', near=f'a{k}')})")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(books=f'b{rounds}')})")
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, v FROM ({_WHOLE.format(scale=1024)})),
x AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM e, range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS i, v FROM x WHERE r <= 256),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, i, j)) AS codebooks_sha256 FROM (SELECT p, i, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM b{rounds})),
c AS (SELECT r, string_agg(printf('%02x', i::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
o AS (SELECT vec_id, label, code, error FROM c JOIN e USING (r))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h"""


ORACLE_SQL = {
    "op11_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
-- sources are cut in the order of 3 * size / weight: those before the first one that its share does not exceed
o AS (SELECT *, coalesce(sum(source_size) OVER w, 0) AS cut_size, coalesce(sum(weight) OVER w, 0) AS cut_weight, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
 FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - 3 * cut_size) * weight > 3 * source_size * (weights - cut_weight) AS above FROM o),
u AS (SELECT min(cut_size) AS cut_size, min(cut_weight) AS cut_weight FROM c WHERE NOT above),
t AS (SELECT source, source_size, CASE WHEN above THEN (3 * source_size)::DOUBLE ELSE ((total - 3 * u.cut_size) * weight)::DOUBLE / (weights - u.cut_weight)::DOUBLE END AS target FROM c, u),
q AS (SELECT doc_id, key, size, d.source, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY key, doc_id, size) AS number,
 sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, repeat, (repeat * source_size + upto)::DOUBLE / target AS finish FROM q, range(3) r(repeat) WHERE size > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, size, source NULLS LAST, number, repeat ROWS UNBOUNDED PRECEDING) AS so_far FROM f),
m AS (SELECT source, number, sum(size) AS taken FROM k WHERE so_far <= (SELECT sum(size) FROM d) GROUP BY source, number)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN m ON q.source IS NOT DISTINCT FROM m.source AND q.number = m.number
""",
    "op12_hard_negatives": f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_WHOLE.format(scale=256)}) WHERE label IS NOT NULL AND vec_id IS NOT NULL),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""",
    "op13_vector_codes": _vector_codes_sql(),
    "op9_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS width, unnest(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, width, count(*) AS n FROM bs GROUP BY item_id, width),
ds AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(0, greatest(len(w) - width, 0) + 1), lambda i: array_to_string(w[i + 1:i + width], ' '))) AS s
 FROM d, (SELECT DISTINCT width FROM bs) v WHERE len(w) > 0),
m AS (SELECT doc_id, item_id, width, count(*) AS matched FROM ds JOIN bs USING (width, s) GROUP BY doc_id, item_id, width)
SELECT doc_id, item_id, matched, n AS n_shingles, matched / n AS containment FROM m JOIN n USING (item_id, width) WHERE matched * 10 >= n * 8
""",
    "op5_url_filters": r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, CASE
 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
}
