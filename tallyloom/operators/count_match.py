"""The second matching engine: trimmed keys, ambiguity falls through, only numbers are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.text import to_whole
from tallyloom.operators.match import cascade

_KEY = {"number": "data_no", "tablet": "tab_no", "composite": "composite"}


def crm_view(crm: DataFrame) -> DataFrame:
    """A customer table with Japanese column names as a ledger; 件数 and 合計値 take the places of two totals."""
    names = {"日付": "date", "店舗名": "store_name", "氏名": "staff_name", "日報データNo": "daily_report_no", "タブレットNo": "tablet_no", "件数": "left_total_1", "合計値": "right_total_1"}
    cols = [F.col(a).cast("string").alias(b) for a, b in names.items()]
    return crm.select(*cols, *[F.lit("").alias(c) for c in S.LEDGER if c not in names.values()]).select(*S.LEDGER)


def match_counts(extracted: DataFrame, crm: DataFrame) -> DataFrame:
    """``extracted`` with ``match_key, status, csv_count, csv_total, diffs, csv_record, reason``.

    ``match_key`` is data_no, tab_no, composite or null.  Numbers are compared where both sides have one;
    a text with a fraction counts as none on the ledger's side.  Extracted rows with an error aren't matched.
    """
    keyed = extracted.select("*", F.col("store").alias("store_name"), F.col("name").alias("staff_name"), F.when(F.col("error").isNull(), F.col("data_no")).alias("daily_report_no"), F.when(F.col("error").isNull(), F.col("tab_no")).alias("tablet_no"))
    keyed = keyed.withColumn("store_name", F.when(F.col("error").isNull(), F.col("store_name")))
    m = cascade(keyed, crm_view(crm), policy="fallthrough", style="trimmed")

    def whole(c: str) -> Column:
        text = F.col(f"r.{c}")
        return F.when(F.regexp(text, F.lit(r"^\s*[+-]?\d+\s*$")), to_whole(text))

    m = m.withColumn("csv_count", whole("left_total_1")).withColumn("csv_total", whole("right_total_1"))

    def differ(label: str, ours: str, theirs: str) -> Column:
        both = F.col(ours).isNotNull() & F.col(theirs).isNotNull() & (F.col(ours) != F.col(theirs))
        return F.when(both, F.struct(F.lit(label).alias("field"), F.col(ours).alias("extracted"), F.col(theirs).alias("csv")))

    m = m.withColumn("diffs", F.array_compact(F.array(differ("件数", "count", "csv_count"), differ("合計値", "total", "csv_total"))))
    key = None
    for stage, name in _KEY.items():
        key = F.when(F.col("stage") == stage, name) if key is None else key.when(F.col("stage") == stage, name)
    status = F.when(F.col("r").isNull(), S.REVIEW).when(F.size("diffs") > 0, S.MISMATCH).otherwise(S.MATCH)
    record = F.create_map(*[x for a, b in (("日報データNo", "daily_report_no"), ("タブレットNo", "tablet_no"), ("日付", "date"), ("店舗名", "store_name"), ("氏名", "staff_name"), ("件数", "left_total_1"), ("合計値", "right_total_1")) for x in (F.lit(a), F.col(f"r.{b}"))])
    return m.withColumn("match_key", key).withColumn("status", status).withColumn("csv_record", F.when(F.col("r").isNotNull(), record)).withColumn("reason", F.col("error"))
