"""Counts and ratios over reconciliation results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.tables import materialize


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def percent_whole(n: Column, of: Column) -> Column:
    """Whole per cent, cut; 0 of nothing."""
    return F.when(of == 0, F.lit(0)).otherwise(F.floor(n.cast("double") / of.cast("double") * F.lit(100.0))).cast("bigint")


def percent_text(n: int, of: int) -> str:
    """Per cent with one decimal, halves to even on the binary value; 0.0 of nothing."""
    return f"{n / of * 100:.1f}" if of else "0.0"


def status_counts(results: DataFrame) -> DataFrame:
    """``status, n`` for all three statuses, 0 for absent ones, in code point order."""
    spark = results.sparkSession
    domain = spark.createDataFrame([(s,) for s in S.STATUSES], "status STRING")
    counted = results.groupBy("status").agg(F.count("*").alias("c"))
    return F.broadcast(domain).join(counted, "status", "left").select("status", F.coalesce("c", F.lit(0)).alias("n")).orderBy("status")


def kpi_cards(results: DataFrame) -> DataFrame:
    """One row: total, and number and whole per cent of each status."""
    one = results.agg(
        F.count("*").alias("total"),
        _count(F.col("status") == S.MATCH).alias("n_match"), _count(F.col("status") == S.MISMATCH).alias("n_mismatch"), _count(F.col("status") == S.REVIEW).alias("n_review"),
    )
    return one.select("total", *[x for k in ("match", "mismatch", "review") for x in (F.col(f"n_{k}"), percent_whole(F.col(f"n_{k}"), F.col("total")).alias(f"pct_{k}"))])


def success_metrics(results: DataFrame) -> DataFrame:
    """One row: the four ways in which success is counted, which differ on purpose."""
    key = F.col("matching_key")
    return results.agg(
        F.count("*").alias("total"),
        _count(F.col("status").isin(S.MATCH, S.MISMATCH)).alias("report_matched"),
        _count((key != S.NOT_FOUND) & ~F.contains(key, F.lit("複数候補"))).alias("auto_identified"),
        _count(F.col("CSV_found") | F.startswith(key, F.lit("複合キー"))).alias("candidate_found"),
        _count(key != S.NOT_FOUND).alias("runner_success"),
    )


def status_by_key(results: DataFrame) -> DataFrame:
    """``matching_key, status, n``."""
    return results.groupBy("matching_key", "status").agg(F.count("*").alias("n"))


def status_rank(c: Column) -> Column:
    """Order in which the statuses are reported."""
    return F.when(c == S.MATCH, 1).when(c == S.MISMATCH, 2).otherwise(3)


def report_items(results: DataFrame, seq: str = "seq", ties: tuple[str, ...] = ("file_name",), width: int = 1_000_000) -> DataFrame:
    """``status, item_no, file_name, matching_key``: numbered from 1 in each status, in input order; a null ``seq`` comes first.

    Rows are numbered within stretches of ``width`` places of the input, and each stretch starts behind the
    counts of those before it, so no task sorts a whole status.  The stretches follow from ``seq`` alone and
    are the same in every evaluation.  The four columns are written once, as they are read twice.
    """
    placed = materialize(results.select("status", "file_name", "matching_key", F.col(seq).alias("_seq"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)], F.coalesce(F.floor(F.col(seq) / width), F.lit(-1)).alias("_b")))
    within = placed.withColumn("_i", F.row_number().over(Window.partitionBy("status", "_b").orderBy("_seq", *[f"_t{i}" for i in range(len(ties))])))
    sizes = placed.groupBy("status", "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("status").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("status", "_b", F.coalesce(before, F.lit(0)).alias("_s"))
    return within.join(starts, ["status", "_b"]).select("status", (F.col("_i") + F.col("_s")).alias("item_no"), "file_name", "matching_key")


def in_order(items: DataFrame) -> DataFrame:
    """Items of :func:`report_items` in the order of the report: statuses by rank, then numbers; an absent status has none."""
    return items.orderBy(status_rank(F.col("status")), "item_no")


def _one_decimal(share: Column) -> Column:
    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda x: f"{x:.1f}")

    return shown(share)


def report_shares(results: DataFrame) -> DataFrame:
    """``label, n, share``: all, each status, matched and unmatched, with the share in per cent to one decimal.

    The decimal is rounded on the binary value, halves to even, which the built-in formats don't do; the
    function sees six rows.  No results: 0.0.
    """
    k = kpi_cards(results)
    counts = {"計": F.col("total"), S.MATCH: F.col("n_match"), S.MISMATCH: F.col("n_mismatch"), S.REVIEW: F.col("n_review"), S.MATCHED: F.col("n_match") + F.col("n_mismatch"), S.UNMATCHED: F.col("n_review")}
    rows = k.select("total", F.inline(F.array(*[F.struct(F.lit(label).alias("label"), n.alias("n")) for label, n in counts.items()])))
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("n").cast("double") / F.col("total").cast("double") * F.lit(100.0))
    return rows.select("label", "n", _one_decimal(share).alias("share"))


def summary_lines(results: DataFrame) -> DataFrame:
    """``line_no, line``: a line for each status that occurs, in code point order, and one for the forms with a candidate."""
    counted = results.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("matching_key") != S.NOT_FOUND).alias("found"))
    one = counted.agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("each"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    lines = F.array_append(F.transform("each", lambda e: F.struct(e["status"].alias("label"), e["n"].alias("n"), F.lit(False).alias("last"))), F.struct(F.lit(S.WITH_CANDIDATE).alias("label"), F.col("found").alias("n"), F.lit(True).alias("last")))
    each = one.select("total", F.posexplode(lines).alias("at", "x"))
    share = F.concat(F.lit(" ("), _one_decimal(F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("x.n").cast("double") / F.col("total").cast("double") * F.lit(100.0))), F.lit("%)"))
    of = F.when(F.col("x.last"), F.concat(F.lit("/"), F.col("total").cast("string"))).otherwise("")
    return each.select((F.col("at") + 1).cast("bigint").alias("line_no"), F.concat(F.col("x.label"), F.lit(": "), F.col("x.n").cast("string"), of, share).alias("line"))


def summary_by(results: DataFrame, *columns: str) -> DataFrame:
    """Number of results for each status within ``columns``."""
    return results.groupBy(*columns, "status").agg(F.count("*").alias("n"))
