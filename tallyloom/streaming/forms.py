"""Forms that arrive as a stream, reconciled with a ledger at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.reconcile import as_forms, reconcile


def stream_forms(spark: SparkSession, folder: str, seq: str = "reading_id") -> DataFrame:
    """Forms of parquet files as they come into ``folder``."""
    schema = spark.read.parquet(folder).schema
    return as_forms(spark.readStream.schema(schema).parquet(folder), seq)


def reconcile_stream(forms: DataFrame, ledger: DataFrame, mode: str = "csv") -> DataFrame:
    """A stream of results.  The key indexes of the ledger are static, so the joins keep no state and need no watermark."""
    return reconcile(forms, ledger, mode)


def running_counts(results: DataFrame) -> DataFrame:
    """Status counts over all results so far, for output mode ``complete``; three groups of state."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def daily_counts(results: DataFrame, at: str, late: str = "30 days") -> DataFrame:
    """Status counts by day of ``at``, final once the watermark has passed; later forms are counted no more."""
    return results.withWatermark(at, late).groupBy(F.window(at, "1 day"), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "status", "n")


