"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.plans.lineage import cut


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or where that is unset (tests) a folder of our own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        where = tempfile.mkdtemp(prefix="flowlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder."""
    return cut(df)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read from there: later readers take the columns they need."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from which the number of tasks is taken where each deals with whole texts."""
    return docs.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it (names clash whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
