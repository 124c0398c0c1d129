"""Sends this package to the Python workers of a session, so that tasks can import it wherever the driver runs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
#: What a batch of rows may take on its way to a Python worker, where the session does not say so itself: rows hold whole
#: texts, and a batch lies in memory several times.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bound_batches(spark: SparkSession) -> None:
    given = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in given:
            spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="flowlake-"), "flowlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("flowlake", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shipped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f(spark, ...)`` after the package was sent and batches were bounded."""

    @wraps(f)
    def call(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        bound_batches(spark)
        return f(spark, *args)

    return call
