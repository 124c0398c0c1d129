"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import decontam, langid, ngram_join, packing, toxicity
from flowlake.llm.common import new_folder, table
from flowlake.ship import shipped


def apart(docs: DataFrame, stage) -> DataFrame:
    """``stage(docs)`` with all columns but doc_id, text and lang under names of their own meanwhile, so that no column an
    operator adds takes the place of one, and no name of an operator's own clashes; they come back as they were."""
    names = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c.lower() not in ("doc_id", "text", "lang")}
    out = stage(docs.select(*(F.col(c).alias(names.get(c, c)) for c in docs.columns)))
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject. Null, empty and wordless texts stay, as their score is 0;
    repeated rows are judged alike; without labels only the fixed words reject. Other columns stay as they are, score and
    predicted among them."""
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return apart(docs, lambda d: toxicity.score(d, lexicon).where("predicted = 0"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null texts and texts without a letter go. Where there is no training row
    at all, every document goes, as no language is known. Other columns stay as they are, score and lang_pred among them."""
    profiles = langid.train(docs)
    return apart(docs, lambda d: langid.identify(d, profiles).where(F.col("lang_pred") != langid.UNKNOWN))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents (five-word shingles 80 % the same): the one with the smallest
    doc_id; rows of one doc_id stay or go together, and rows without one stay. Other columns stay as they are."""
    linked = ngram_join.link_components(docs.select("doc_id", "text"), width=5, similarity=0.8).where("component_id <> doc_id").select("doc_id")
    return apart(docs, lambda d: d.join(linked.distinct(), "doc_id", "left_anti"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none and stay; rows of one doc_id are one
    document and go together; rows without a doc_id go by their own texts. Other columns stay as they are."""
    return apart(docs, lambda d: decontam.without_items(d, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document left: a null or empty text is one piece of the end id alone, repeated rows
    are packed each, very long texts are cut into pieces."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", shipped(drop_toxic)),
    ("language_id", shipped(keep_languages)),
    ("ngram_jaccard_join", shipped(drop_near_copies)),
    ("benchmark_decontamination", shipped(drop_benchmark_leaks)),
    ("best_fit_packing", shipped(pack)),
]

#: Learned stages and packing are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
