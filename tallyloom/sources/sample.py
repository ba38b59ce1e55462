"""A small set of forms and ledger rows with every outcome, for trying things out."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession

from tallyloom import schema as S
from tallyloom.plans.reconcile import as_forms, as_ledger

# The rows of the sample.
LEDGER_CSV = "\n".join(
    [",".join(S.LEDGER)]
    + [
        f"2026-04-20,店舗{i:02},担当{i:02},{i:04},1A~{2002200 + i},{28 + i},{t},{r1},{r2}"
        for i, (t, r1, r2) in enumerate([
            ("9,3", 27, 5), ("8,2", 26, 4), ("7,1", 25, 3), ("6,4", 24, 2), ("5,5", 23, 1), ("4,6", 22, 6), ("3,7", 21, 7), ("2,8", 20, 8),
            ("1,9", 19, 9), ("0,3", 18, 5), ("9,2", 17, 4), ("8,1", 16, 3), ("7,4", 15, 2), ("6,5", 14, 1), ("5,6", 13, 6),
        ], 1)
    ]
    + ["2026-04-20,店舗01,担当01,0101,1A~2002301,10,1,1,10,1", "2026-04-20,店舗01,担当01,0102,1A~2002302,11,2,2,11,2", ""]
)

_FORMS = """report_01.pdf,2026-04-20,店舗01,担当01,0001,1A~2002201,29/9/3,27/5,False
report_02.pdf,2026-04-20,店舗02,担当02,0002,1A~2002202,30/8/3,26/4,False
report_03.pdf,2026-04-20,店舗03,担当03,0003,1A~2002203,31/7/1,25/8,False
report_04.pdf,2026-04-20,店舗04,担当04,9004,1A~2002204,32/6/4,24/2,False
report_05.pdf,2026-04-20,店舗05,担当05,0005,1A~2009999,33/5/5,23/1,False
report_06.pdf,2026-04-20,店舗06,担当06,0006,1a~ 2002206,34/4/6,22/6,False
report_07.pdf,2026-04-20,店舗07,担当07,0007,1A~2002207,35/3/7,21/7,False
report_08.pdf,2026-04-20,店舗08,担当08,0008,1A~2002208,36 / 2 / 8,20/8,False
report_09.pdf,2026-04-20,店舗09,担当09,0009,1A~2002209,37/1/9,19/9,False
report_10.pdf,2026-04-20,店舗10,担当10,0010,1A~2002210,38/0/3,18/5,False
report_11.pdf,2026-04-20,店舗11,担当11,0011,1A~2002211,39/9/2,17/4,False
report_12.pdf,2026-04-20,店舗12,担当12,0012,1A~2002212,40/8/1,16/3,False
report_13.pdf,2026-04-20,店舗13,担当13,0013,1A~2002213,41/7/4,15/2,False
report_14.pdf,2026-04-20,店舗14,担当14,0014,1A~2002214,42/6/5,14/1,False
report_15.pdf,2026-04-20,店舗15,担当15,0015,1A~2002215,43/5/6,13/6,False
task_1.pdf,2026-04-21,店舗99,担当99,9998,9Z~0000000,1/1/1,1/1,False
task_2b.pdf,2026-04-20,店舗01,担当01,9997,9Z~0000001,29/9/3,27/5,False
"""
FORMS_CSV = ",".join(S.FORM_TEXT) + "\n" + _FORMS


# Answers for four pages (a match, another count, no report number, nothing to go by), and their ledger.
_ANSWERS = [
    ("2026-05-06", "渋谷店", "田中太郎", "001", "AB-01", 5, "12500"), ("2026-05-06", "新宿店", "山田花子", "002", "AB-02", 6, "15000"),
    ("2026-05-06", "池袋店", "佐藤次郎", "", "CD-03", 3, "7500"), ("2026-05-06", "渋谷店", "佐藤三郎", "", "", None, ""),
]
_CRM = [
    ("2026-05-06", "渋谷店", "田中太郎", "001", "AB-01", "5", "12500"), ("2026-05-06", "新宿店", "山田花子", "002", "AB-02", "5", "15000"),
    ("2026-05-06", "池袋店", "佐藤次郎", "003", "CD-03", "3", "7500"),
]
CRM_COLUMNS = ["日付", "店舗名", "氏名", "日報データNo", "タブレットNo", "件数", "合計値"]


def load_pages(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Four pages with their answers (``page_id, file_name, page_number, response_text``), and a ledger with counts for the second engine."""
    keys = ["date", "store", "name", "data_no", "tab_no", "count", "total"]
    pages = [(i, f"page_{i:02}.pdf", i, json.dumps(dict(zip(keys, a, strict=True)), ensure_ascii=False)) for i, a in enumerate(_ANSWERS, 1)]
    return spark.createDataFrame(pages, "page_id BIGINT, file_name STRING, page_number INT, response_text STRING"), spark.createDataFrame(_CRM, ", ".join(f"`{c}` STRING" for c in CRM_COLUMNS))


def _rows(text: str) -> list[tuple[str, ...]]:
    return [tuple(r) for r in csv.reader(io.StringIO(text))][1:]


def load_sample(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The sample's forms and ledger."""
    columns = ", ".join(f"{c} STRING" for c in S.FORM_TEXT) + ", seq BIGINT"
    forms = spark.createDataFrame([(*r, i) for i, r in enumerate(_rows(FORMS_CSV))], columns)
    return as_forms(forms), as_ledger(spark.createDataFrame(_rows(LEDGER_CSV), S.LEDGER_SCHEMA))
