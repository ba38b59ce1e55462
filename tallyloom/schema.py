"""Schemas and the fixed texts of results."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

# Statuses, matching keys, messages, and the columns of inputs and outputs.
MATCH, MISMATCH, REVIEW = "一致", "不一致", "要確認"
STATUSES = [MATCH, MISMATCH, REVIEW]

BY_NUMBER, BY_TABLET, BY_COMPOSITE = "日報DataNo", "タブレットNo", "複合キー（日付+店舗名+氏名）"
BY_NUMBER_MANY, BY_TABLET_MANY, BY_COMPOSITE_MANY = "日報DataNo（複数候補）", "タブレットNo（複数候補）", "複合キー（複数候補）"
NOT_FOUND = "見つかりませんでした"

UNREAD = "未読取"
MATCHED, UNMATCHED, WITH_CANDIDATE = "マッチング成功", "マッチング失敗（要確認）", "候補あり"
PAGE_OK, PAGE_ERROR, PAGE_PARTIAL = "[OK] Success", "[ERROR] ", "[WARN] Partial (missing DataNo or TabNo)"
NO_RECORD = "CSV内に対応するレコードが見つかりません"
TOTALS_UNREAD = "帳票合計欄の読み取り未対応または未取得のため、確認が必要です"

KEYS = ["date", "store_name", "staff_name", "daily_report_no", "tablet_no"]
LEFT = ["left_total_1", "left_total_2", "left_total_3"]
RIGHT = ["right_total_1", "right_total_2"]
LEDGER = [*KEYS, *LEFT, *RIGHT]
FORM_TEXT = ["file_name", *KEYS, "left_totals", "right_totals", "needs_review"]

LEDGER_SCHEMA = StructType([StructField(c, StringType()) for c in LEDGER])
FORM_TEXT_SCHEMA = StructType([StructField(c, StringType()) for c in FORM_TEXT])
FORM_SCHEMA = StructType([
    StructField("file_name", StringType()),
    *(StructField(c, StringType()) for c in KEYS),
    StructField("left_totals", ArrayType(StringType(), False)),
    StructField("right_totals", ArrayType(StringType(), False)),
    StructField("needs_review", BooleanType()),
    StructField("seq", LongType()),
])
#: Keys of the reading model's answer, all read as text.
RESPONSE = ["date", "store", "name", "data_no", "tab_no", "count", "total", "notes", "left_total", "right_total"]
RESPONSE_SCHEMA = StructType([StructField(c, StringType()) for c in RESPONSE])

RESULT = ["file_name", "matching_key", *(f"帳票_{c}" for c in [*KEYS, "left_totals", "right_totals"]), *(f"CSV_{c}" for c in [*KEYS, "left_totals", "right_totals"]), "status", "differences", "review_reasons"]
_SHORT = ["日付", "店舗", "スタッフ", "DataNo", "TabNo", "左下合計", "右下合計"]
EXPORT = ["ファイル", "マッチング方式", *(f"帳票_{c}" for c in _SHORT), *(f"CSV_{c}" for c in _SHORT), "ステータス", "差分内容", "確認理由"]
REPORT_FIELDS = ["日付", "店舗名", "氏名", "日報DataNo", "タブレットNo", "左下合計", "右下合計"]
#: Compared fields in the order of their messages: label, form field, ledger field.
FIELDS = [("日報DataNo", "daily_report_no"), ("タブレットNo", "tablet_no"), ("日付", "date"), ("店舗名", "store_name"), ("氏名", "staff_name"), ("左下合計欄", "left_totals"), ("右下合計欄", "right_totals")]
PAGE = ["page_number", "date", "store", "name", "data_no", "tab_no", "count", "total", "notes", "left_totals", "right_totals", "error", "filename"]
