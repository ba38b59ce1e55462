"""Answers of the reading model, and the second engine."""

import pytest
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.operators.count_match import match_counts
from tallyloom.operators.extract import normalize_extraction, page_name, page_status, page_success, parse_response, to_forms

ANSWERS = {
    "bare": '{"date": " 2026-01-01 ", "data_no": "001", "tab_no": "T", "count": 5, "total": "12.9", "left_total": 1.5}',
    "tagged": 'Here:\n```json\n{"data_no": "002", "count": "abc"}\n```\nend',
    "fence": '```\n{"tab_no": "T3", "count": -3.7, "notes": "  "}\n```',
    "broken": '{"data_no": "1"',
    "list": "[1, 2]",
    "empty": "",
    "null": None,
    "long": '{"notes": "' + "あ" * 100_000 + '"}',
}


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(ANSWERS.items())], "id STRING, n INT, text STRING").withColumn("raw", F.lit("other"))
    return {r.id: r for r in page_status(normalize_extraction(parse_response(df, "text"))).collect()}


def test_parsing(pages):
    assert pages["bare"].date == "2026-01-01" and pages["bare"]["count"] == 5 and pages["bare"].total == 12 and pages["bare"].left_total == 1.5
    assert pages["tagged"].data_no == "002" and pages["tagged"]["count"] is None
    assert pages["fence"].tab_no == "T3" and pages["fence"]["count"] == -3 and pages["fence"].notes is None
    assert pages["broken"].data_no is None and pages["broken"].parse_failed and pages["broken"].error is None
    assert pages["list"].error and not pages["list"].parse_failed
    assert pages["empty"].error is None and pages["null"].error is None and len(pages["long"].notes) == 100_000


def test_page_status(pages, spark):
    assert pages["bare"].page_status == "[OK] Success" and pages["tagged"].page_status.startswith("[WARN]") and pages["list"].page_status.startswith("[ERROR]")
    df = spark.createDataFrame([(v.page_status,) for v in pages.values()], "page_status STRING")
    assert tuple(page_success(df).first()) == (1, len(ANSWERS))
    assert spark.range(1).select(page_name(F.lit(3))).first()[0] == "page_03"


def test_forms_always_ask_for_review(spark):
    df = normalize_extraction(parse_response(spark.createDataFrame([("a.pdf", 7, ANSWERS["bare"])], "f STRING, n INT, text STRING"), "text"))
    r = to_forms(df, "f", "n").first()
    assert (r.file_name, r.daily_report_no, r.left_totals, r.needs_review, r.seq) == ("a.pdf", "001", [], True, 7)


def test_second_engine(spark):
    crm = spark.createDataFrame([
        ("d", "s", "p", " 001", "T1", "5", "10"), ("d", "s", "p", "002", "T2", "6", "12.5"), ("d", "s", "p", "002", "T3", "7", "1"), ("e", "s", "p", "", "", "8", "1"),
    ], ["日付", "店舗名", "氏名", "日報データNo", "タブレットNo", "件数", "合計値"])
    rows = [
        ("exact", None, "001 ", None, None, None, None, 5, 10), ("through", None, "002", "T3", None, None, None, 7, 2), ("composite", None, None, None, "e", "s", "p", None, None),
        ("none", None, "9", "9", "x", "s", "p", 1, 1), ("error", "bad", "001", "T1", "d", "s", "p", 5, 10), ("fraction", None, "9", "T2", None, None, None, 6, 99),
    ]
    df = spark.createDataFrame(rows, "id STRING, error STRING, data_no STRING, tab_no STRING, date STRING, store STRING, name STRING, count BIGINT, total BIGINT")
    got = {r.id: (r.match_key, r.status, [(d.field, d.extracted, d.csv) for d in r.diffs]) for r in match_counts(df, crm).collect()}
    assert got == {
        "exact": ("data_no", S.MATCH, []), "through": ("tab_no", S.MISMATCH, [("合計値", 2, 1)]), "composite": ("composite", S.MATCH, []),
        "none": (None, S.REVIEW, []), "error": (None, S.REVIEW, []), "fraction": ("tab_no", S.MATCH, []),
    }
    assert match_counts(df, crm.limit(0)).where("status <> '要確認'").count() == 0
