"""The reconciliation of forms with a ledger as one plan, and the views of its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.text import blank, blank_to_null, join_list, or_placeholder, parse_flag, parse_totals
from tallyloom.operators.diff import field_pairs, with_diffs, with_status
from tallyloom.operators.match import cascade


def as_forms(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Text columns of a form table as forms; ``seq`` is the column that gives the input order."""
    return raw.select(
        F.col("file_name"), *[blank_to_null(F.col(c)).alias(c) for c in S.KEYS],
        parse_totals(F.col("left_totals")).alias("left_totals"), parse_totals(F.col("right_totals")).alias("right_totals"),
        parse_flag(F.col("needs_review")).alias("needs_review"), F.col(seq).cast("bigint").alias("seq"),
    )


def as_ledger(raw: DataFrame) -> DataFrame:
    """Text columns of a ledger table as ledger rows: ten texts, never null.  Every row counts, resends too."""
    return raw.select(*[blank(F.col(c)).alias(c) for c in S.LEDGER])


def reconcile(forms: DataFrame, ledger: DataFrame, mode: str = "csv", policy: str = "stop") -> DataFrame:
    """One result for each form: the form's fields with ``matching_key, r, diffs, status, differences, review_reasons``.

    Three unique key indexes, three left joins that never multiply forms, one lookup of the row by its
    hash, then projections; nothing is collected and there is no Python.
    """
    return with_status(with_diffs(cascade(forms, ledger, policy)), mode)


def _found(value: Column) -> Column:
    return blank(F.when(F.col("r").isNotNull(), value))


def result_columns() -> list[Column]:
    """The 19 text columns of a stored result."""
    form = [blank(F.col(c)) for c in S.KEYS] + [join_list(F.col("left_totals")), join_list(F.col("right_totals"))]
    row = [_found(F.col(f"r.{c}")) for c in S.KEYS]
    row += [_found(F.array_join(F.array(*[F.col(f"r.{c}") for c in part]), "/")) for part in (S.LEFT, S.RIGHT)]
    values = [F.col("file_name"), F.col("matching_key"), *form, *row, F.col("status"), F.array_join("differences", " | "), F.array_join("review_reasons", " | ")]
    return [v.alias(n) for v, n in zip(values, S.RESULT, strict=True)]


def result_rows(results: DataFrame) -> DataFrame:
    """Results as 19 text columns."""
    return results.select(*result_columns())


def export_rows(results: DataFrame) -> DataFrame:
    """The same under the headers of the download."""
    return result_rows(results).toDF(*S.EXPORT)


def table_view(results: DataFrame) -> DataFrame:
    """Six columns for reading, ``-`` for null and empty."""
    cols = {"ファイル名": "file_name", "照合方法": "matching_key", "日付": "date", "店舗": "store_name", "担当者": "staff_name", "ステータス": "status"}
    return results.select(*[or_placeholder(F.col(c), "-").alias(n) for n, c in cols.items()])


def detail_rows(results: DataFrame) -> DataFrame:
    """Seven rows a result: ``seq, file_name, label, form_value, csv_value``; ``-`` for null and empty."""
    each = F.array(*[
        F.struct(F.lit(label).alias("label"), or_placeholder(form, "-").alias("form_value"), F.when(F.col("r").isNotNull(), or_placeholder(other, "-")).otherwise("-").alias("csv_value"))
        for label, form, other, _ in field_pairs()
    ])
    return results.select("seq", "file_name", F.inline(each))


def diff_rows(results: DataFrame) -> DataFrame:
    """One row for each differing field of the rows that were found, whatever the status."""
    return results.select("seq", "file_name", F.inline("diffs"))


def correction_rows(results: DataFrame) -> DataFrame:
    """One row for each field to be corrected: day, store, person, field, value on the form, state."""
    one = results.where(F.col("status") == S.MISMATCH).select(F.col("r"), F.explode("diffs").alias("d"))
    return one.select(
        F.col("r.date").alias("対象日"), F.col("r.store_name").alias("店舗名"), F.col("r.staff_name").alias("担当者名"),
        F.col("d.field").alias("修正対象項目"), F.col("d.form_value").alias("修正候補値"), F.lit("未確認").alias("確認状態"),
    )


def point(results: DataFrame, seq: int) -> DataFrame:
    """The results of one place in the input, with the label under which they are chosen."""
    return results.where(F.col("seq") == seq).withColumn("label", F.concat("file_name", F.lit(" - "), "status"))


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first rows in a stated order, all texts kept as they are."""
    return df.orderBy(*order).limit(n)
