"""The core queries as SQL."""

from __future__ import annotations

_S = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _totals(c: str) -> str:
    return f"[{_trim('x')} for x in string_split(coalesce({c}, ''), '/') if {_trim('x')} <> '']"


def _norm(c: str) -> str:
    return f"lower(replace(replace(nullif({c}, ''), ' ', ''), '¶', 'it'))"


_KEYS = ["date", "store_name", "staff_name", "daily_report_no", "tablet_no"]
_LEDGER = [*_KEYS, "left_total_1", "left_total_2", "left_total_3", "right_total_1", "right_total_2"]

FORMS = (
    "forms AS (SELECT row_number() OVER () AS fid, reading_id AS seq, file_name, "
    + ", ".join(f"nullif({c}, '') AS {c}" for c in _KEYS)
    + f", {_totals('left_totals')} AS lt, {_totals('right_totals')} AS rt, coalesce(lower(needs_review) = 'true', false) AS needs_review FROM form_readings)"
)
LEDGER = "ledger AS (SELECT row_number() OVER () AS lid, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _LEDGER) + " FROM ledger_records)"


def _indexes(number: str, tablet: str, composite: list[str]) -> str:
    parts = ", ".join(f"{e} AS k{i}" for i, e in enumerate(composite))
    where = " AND ".join(f"coalesce({e}, '') <> ''" for e in composite)
    return (
        f"i1 AS (SELECT {number} AS k, count(*) AS n, min(lid) AS lid FROM ledger WHERE {number} <> '' GROUP BY 1), "
        f"i2 AS (SELECT {tablet} AS k, count(*) AS n, min(lid) AS lid FROM ledger WHERE {tablet} IS NOT NULL GROUP BY 1), "
        f"i3 AS (SELECT {parts}, count(*) AS n, min(lid) AS lid FROM ledger WHERE {where} GROUP BY ALL)"
    )


_EXACT = _indexes("daily_report_no", _norm("tablet_no"), ["date", "store_name", "staff_name"])
_TRIMMED = _indexes(_trim("daily_report_no"), f"nullif({_trim('tablet_no')}, '')", [_trim("date"), _trim("store_name"), _trim("staff_name")])


def _counted(forms: str, number: str, tablet: str, composite: list[str]) -> str:
    on = " AND ".join(f"{e} = i3.k{i}" for i, e in enumerate(composite))
    return (
        f"counted AS (SELECT f.*, coalesce(i1.n, 0) AS n1, coalesce(i2.n, 0) AS n2, coalesce(i3.n, 0) AS n3, i1.lid AS l1, i2.lid AS l2, i3.lid AS l3 "
        f"FROM {forms} f LEFT JOIN i1 ON {number} = i1.k LEFT JOIN i2 ON {tablet} = i2.k LEFT JOIN i3 ON {on})"
    )


_COUNTED = _counted("forms", "f.daily_report_no", _norm("f.tablet_no"), ["f.date", "f.store_name", "f.staff_name"])
_LABEL = (
    "CASE WHEN n1 = 1 THEN '日報DataNo' WHEN n1 > 1 THEN '日報DataNo（複数候補）' WHEN n2 = 1 THEN 'タブレットNo' WHEN n2 > 1 THEN 'タブレットNo（複数候補）' "
    "WHEN n3 = 1 THEN '複合キー（日付+店舗名+氏名）' WHEN n3 > 1 THEN '複合キー（複数候補）' ELSE '見つかりませんでした' END"
)
_MATCHED = (
    f"m AS (SELECT counted.*, {_LABEL} AS matching_key, CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE n3 END AS n, "
    "CASE WHEN n1 > 0 THEN CASE WHEN n1 = 1 THEN l1 END WHEN n2 > 0 THEN CASE WHEN n2 = 1 THEN l2 END WHEN n3 = 1 THEN l3 END AS lid FROM counted)"
)
_JOINED = "j AS (SELECT m.*, " + ", ".join(f"g.{c} AS g_{c}" for c in _LEDGER) + " FROM m LEFT JOIN ledger g ON m.lid = g.lid)"

_GL, _GR = "concat_ws('/', g_left_total_1, g_left_total_2, g_left_total_3)", "concat_ws('/', g_right_total_1, g_right_total_2)"
_FIELDS = [
    ("日報DataNo", "daily_report_no", "g_daily_report_no", "coalesce(daily_report_no, '') <> g_daily_report_no"),
    ("タブレットNo", "tablet_no", "g_tablet_no", f"{_norm('tablet_no')} IS DISTINCT FROM {_norm('g_tablet_no')}"),
    ("日付", "date", "g_date", "coalesce(date, '') <> g_date"),
    ("店舗名", "store_name", "g_store_name", "coalesce(store_name, '') <> g_store_name"),
    ("氏名", "staff_name", "g_staff_name", "coalesce(staff_name, '') <> g_staff_name"),
    ("左下合計欄", "array_to_string(lt, '/')", _GL, "lt <> [g_left_total_1, g_left_total_2, g_left_total_3]"),
    ("右下合計欄", "array_to_string(rt, '/')", _GR, "rt <> [g_right_total_1, g_right_total_2]"),
]


def _either(c: str, shown: str) -> str:
    return f"coalesce(nullif({c}, ''), '{shown}')"


_DIFFS = "d AS (SELECT j.*, [x FOR x IN [" + ", ".join(
    f"CASE WHEN lid IS NOT NULL AND {differs} THEN '{label}: 帳票=' || {_either(form, '未読取')} || ', CSV=' || {other} END" for label, form, other, differs in _FIELDS
) + "] IF x IS NOT NULL] AS diffs FROM j)"


def _results(pdf: bool = False) -> str:
    reasons = (
        "CASE WHEN n = 0 THEN 'CSV内に対応するレコードが見つかりません' WHEN n > 1 THEN '複数の候補レコードが見つかりました（' || n || '件）' "
        "WHEN needs_review THEN '帳票合計欄の読み取り未対応または未取得のため、確認が必要です' ELSE '' END"
    )
    if pdf:
        reasons = f"CASE WHEN needs_review AND len(lt) = 0 AND len(rt) = 0 THEN '帳票合計欄の読み取り未対応または未取得のため、確認が必要です' ELSE {reasons} END"
    return (
        "res AS (SELECT d.*, CASE WHEN n <> 1 OR needs_review THEN '要確認' WHEN len(diffs) > 0 THEN '不一致' ELSE '一致' END AS status, "
        f"CASE WHEN n = 1 AND NOT needs_review THEN array_to_string(diffs, ' | ') ELSE '' END AS differences, {reasons} AS review_reasons FROM d)"
    )


_BASE = f"WITH {FORMS}, {LEDGER}, {_EXACT}, {_COUNTED}, {_MATCHED}, {_JOINED}, {_DIFFS}, {_results()} "
_PLAIN = f"WITH {FORMS}, {LEDGER}, {_EXACT}, {_COUNTED}, {_MATCHED}, {_JOINED} "

_VALUES = [
    "file_name", "matching_key", *(f"coalesce({c}, '')" for c in _KEYS), "array_to_string(lt, '/')", "array_to_string(rt, '/')", *(f"coalesce(g_{c}, '')" for c in _KEYS),
    f"CASE WHEN lid IS NULL THEN '' ELSE {_GL} END", f"CASE WHEN lid IS NULL THEN '' ELSE {_GR} END", "status", "differences", "review_reasons",
]


def _named(names: list[str]) -> str:
    return ", ".join(f'{v} AS "{n}"' for v, n in zip(_VALUES, names, strict=True))


def _unpivot(shown: str, where: bool) -> str:
    parts = []
    for label, form, other, differs in _FIELDS:
        right = f"coalesce({other}, '')" if where else f"CASE WHEN lid IS NULL THEN '{shown}' ELSE {_either(other, shown)} END"
        cond = f" WHERE lid IS NOT NULL AND {differs}" if where else ""
        parts.append(f"SELECT file_name, '{label}' AS label, {_either(form, shown)} AS form_value, {right} AS csv_value FROM j{cond}")
    return " UNION ALL ".join(parts)


# answers of the reading model
_BODY = (
    "CASE WHEN contains(response_text, '```json') THEN split_part(split_part(response_text, '```json', 2), '```', 1) "
    "WHEN contains(response_text, '```') THEN split_part(response_text, '```', 2) ELSE response_text END"
)
_RAW = ["date", "store", "name", "data_no", "tab_no", "count", "total", "notes", "left_total", "right_total"]
_PAGES = (
    f"pb AS (SELECT *, {_trim(_BODY)} AS body FROM page_responses), "
    "pj AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS js FROM pb), "
    "pages AS (SELECT page_id, file_name, page_number, js IS NOT NULL AND json_type(js) <> 'OBJECT' AS is_error, "
    + ", ".join(f"CASE WHEN json_type(js) = 'OBJECT' THEN js->>'{c}' END AS {c}" for c in _RAW)
    + " FROM pj)"
)


def _number(c: str) -> str:
    return f"CASE lower({c}) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE TRY_CAST({_trim(c)} AS DOUBLE) END"


_TYPED = (
    "typed AS (SELECT page_id, file_name, page_number, is_error, "
    + ", ".join(f"nullif({_trim(c)}, '') AS {c}" for c in ("date", "store", "name", "data_no", "tab_no", "notes"))
    + ", "
    + ", ".join(f"TRY_CAST(trunc({_number(c)}) AS BIGINT) AS {c}" for c in ("count", "total"))
    + ", "
    + ", ".join(f"{_number(c)} AS {c}" for c in ("left_total", "right_total"))
    + " FROM pages)"
)
_PDF_FORMS = (
    "forms AS (SELECT page_id AS fid, page_id AS seq, file_name, date, store AS store_name, name AS staff_name, data_no AS daily_report_no, tab_no AS tablet_no, "
    "CAST([] AS VARCHAR[]) AS lt, CAST([] AS VARCHAR[]) AS rt, true AS needs_review FROM typed)"
)
_STATUS = "CASE WHEN is_error THEN '[ERROR] the answer is no JSON object' WHEN data_no IS NOT NULL AND tab_no IS NOT NULL THEN '[OK] Success' ELSE '[WARN] Partial (missing DataNo or TabNo)' END"

_B_FORMS = "bf AS (SELECT page_id, is_error, count, total, CASE WHEN NOT is_error THEN data_no END AS a, CASE WHEN NOT is_error THEN tab_no END AS b, date, CASE WHEN NOT is_error THEN store END AS store, name FROM typed)"
_B_PICK = (
    "bm AS (SELECT *, CASE WHEN n1 = 1 THEN 'data_no' WHEN n2 = 1 THEN 'tab_no' WHEN n3 = 1 THEN 'composite' END AS match_key, "
    "CASE WHEN n1 = 1 THEN l1 WHEN n2 = 1 THEN l2 WHEN n3 = 1 THEN l3 END AS lid FROM counted)"
)


def _whole(c: str) -> str:
    return rf"CASE WHEN regexp_matches({c}, '^\s*[+-]?\d+\s*$') THEN TRY_CAST(trim({c}) AS BIGINT) END"


_B_JOIN = f"bj AS (SELECT bm.*, {_whole('g.left_total_1')} AS csv_count, {_whole('g.right_total_1')} AS csv_total FROM bm LEFT JOIN ledger g ON bm.lid = g.lid)"
_B_DIFF = "concat_ws(' | ', CASE WHEN count <> csv_count THEN '件数:' || count || '/' || csv_count END, CASE WHEN total <> csv_total THEN '合計値:' || total || '/' || csv_total END)"

_TABLE = {"ファイル名": "file_name", "照合方法": "matching_key", "日付": "date", "店舗": "store_name", "担当者": "staff_name", "ステータス": "status"}
_RANK = "CASE status WHEN '一致' THEN 1 WHEN '不一致' THEN 2 ELSE 3 END"
_SHORT = ["日付", "店舗", "スタッフ", "DataNo", "TabNo", "左下合計", "右下合計"]
_SEVEN = [*_KEYS, "left_totals", "right_totals"]


def _share(s: str) -> str:
    return f"CAST(floor(CAST(count(*) FILTER (status = '{s}') AS DOUBLE) / count(*) * 100.0) AS BIGINT)"


def _one_decimal(n: str) -> str:
    return f"printf('%.1f', CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE CAST({n} AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 END)"


_COUNTED_STATUS = (
    "k AS (SELECT count(*) AS total, count(*) FILTER (status = '一致') AS a, count(*) FILTER (status = '不一致') AS b, count(*) FILTER (status = '要確認') AS c, "
    "count(*) FILTER (matching_key <> '見つかりませんでした') AS found FROM res)"
)
_PAGE_TEXT = ["date", "store", "name", "data_no", "tab_no"]

SQL = {
    "triangle_check": "SELECT record_id, CASE WHEN l1 IS NOT NULL AND r1 IS NOT NULL AND l2 + l3 IS NOT NULL THEN l1 = r1 AND r1 = l2 + l3 END AS agree FROM (SELECT record_id, "
    + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {n}" for n, c in (("l1", "left_total_1"), ("l2", "left_total_2"), ("l3", "left_total_3"), ("r1", "right_total_1")))
    + " FROM ledger_records)",
    "totals_repr": f"WITH {FORMS} SELECT file_name, CASE WHEN len(lt) > 0 THEN '[' || chr(39) || array_to_string(lt, chr(39) || ', ' || chr(39)) || chr(39) || ']' ELSE '' END AS left_repr FROM forms",
    "report_ordered": _BASE + f"SELECT {_RANK} AS group_no, status, row_number() OVER (PARTITION BY {_RANK} ORDER BY seq, file_name) AS item_no, file_name FROM res",
    "report_shares": _BASE.rstrip() + f", {_COUNTED_STATUS} "
    + " UNION ALL ".join(f"SELECT '{label}' AS label, {n} AS n, {_one_decimal(n)} AS share FROM k" for label, n in (("計", "total"), ("一致", "a"), ("不一致", "b"), ("要確認", "c"), ("マッチング成功", "(a + b)"), ("マッチング失敗（要確認）", "c"))),
    "summary_lines": _BASE.rstrip() + f", {_COUNTED_STATUS}, shown AS ("
    + " UNION ALL ".join(f"SELECT {i} AS place, '{label}: ' || {n} || ' (' || {_one_decimal(n)} || '%)' AS line FROM k WHERE {n} > 0" for i, (label, n) in enumerate((("一致", "a"), ("不一致", "b"), ("要確認", "c"))))
    + f" UNION ALL SELECT 3, '候補あり: ' || found || '/' || total || ' (' || {_one_decimal('found')} || '%)' FROM k) SELECT row_number() OVER (ORDER BY place) AS line_no, line FROM shown",
    "point_result": _BASE + "SELECT seq, file_name || ' - ' || status AS label, matching_key FROM res WHERE seq = 100",
    "forms_csv_roundtrip": f"WITH {FORMS} SELECT file_name, {', '.join(_KEYS)}, array_to_string(lt, '/') AS left_totals, array_to_string(rt, '/') AS right_totals, needs_review FROM forms",
    "ledger_csv_roundtrip": f"WITH {LEDGER} SELECT {', '.join(_LEDGER)} FROM ledger",
    "results_csv_roundtrip": _BASE + "SELECT " + _named(["file_name", "matching_key", *(f"帳票_{c}" for c in _SEVEN), *(f"CSV_{c}" for c in _SEVEN), "status", "differences", "review_reasons"]) + " FROM res",
    "pages_csv_roundtrip": f"WITH {_PAGES}, {_TYPED} SELECT coalesce(CAST(page_number AS VARCHAR), '') AS page_number, "
    + ", ".join(f"coalesce({c}, '') AS {c}" for c in _PAGE_TEXT)
    + ", coalesce(CAST(count AS VARCHAR), '') AS count, coalesce(CAST(total AS VARCHAR), '') AS total, coalesce(notes, '') AS notes, '' AS left_totals, '' AS right_totals, "
    "CASE WHEN is_error THEN 'the answer is no JSON object' ELSE '' END AS error, coalesce(file_name, '') AS filename FROM typed",
    "forms_scan": f"WITH {FORMS} SELECT file_name, {', '.join(_KEYS)}, array_to_string(lt, '/') AS left_totals, array_to_string(rt, '/') AS right_totals, needs_review FROM forms",
    "ledger_scan": f"WITH {LEDGER} SELECT {', '.join(_KEYS)}, concat_ws('/', left_total_1, left_total_2, left_total_3) AS left_totals, concat_ws('/', right_total_1, right_total_2) AS right_totals FROM ledger",
    "tablet_normalize": f"SELECT DISTINCT tablet_no, {_norm('tablet_no')} AS norm FROM form_readings",
    "totals_parse": f"WITH {FORMS} SELECT file_name, CAST(len(lt) AS BIGINT) AS n_left, array_to_string(lt, '/') AS left_joined FROM forms",
    "match_data_no": _PLAIN + "SELECT file_name, n1 AS n_candidates FROM counted",
    "match_tablet_no": _PLAIN + "SELECT file_name, n2 AS n_candidates FROM counted",
    "match_composite": _PLAIN + "SELECT file_name, n3 AS n_candidates FROM counted",
    "cascade_match": _PLAIN + "SELECT file_name, matching_key, n AS n_candidates, g_daily_report_no AS matched_daily_report_no FROM j",
    "cascade_fallthrough": f"WITH {FORMS}, {LEDGER}, {_TRIMMED}, "
    + _counted("forms", _trim("f.daily_report_no"), _trim("f.tablet_no"), [_trim("f.date"), _trim("f.store_name"), _trim("f.staff_name")])
    + ", m AS (SELECT *, CASE WHEN n1 = 1 THEN 'number' WHEN n2 = 1 THEN 'tablet' WHEN n3 = 1 THEN 'composite' END AS match_key, CASE WHEN n1 = 1 THEN l1 WHEN n2 = 1 THEN l2 WHEN n3 = 1 THEN l3 END AS lid FROM counted) "
    "SELECT file_name, match_key, g.daily_report_no AS matched_daily_report_no FROM m LEFT JOIN ledger g ON m.lid = g.lid",
    "cascade_narrow": f"WITH {FORMS}, {LEDGER}, {_EXACT}, {_COUNTED}, "
    f"i4 AS (SELECT daily_report_no AS k, {_norm('tablet_no')} AS k2, count(*) AS n, min(lid) AS lid FROM ledger WHERE daily_report_no <> '' AND {_norm('tablet_no')} IS NOT NULL GROUP BY ALL), "
    f"c4 AS (SELECT c.*, coalesce(i4.n, 0) AS n4, i4.lid AS l4 FROM counted c LEFT JOIN i4 ON c.daily_report_no = i4.k AND {_norm('c.tablet_no')} = i4.k2), "
    f"m AS (SELECT c4.*, CASE WHEN n1 > 1 AND n4 = 1 THEN '日報DataNo' ELSE {_LABEL} END AS matching_key, CASE WHEN n1 > 1 AND n4 = 1 THEN 1 WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE n3 END AS n, "
    "CASE WHEN n1 > 1 AND n4 = 1 THEN l4 WHEN n1 > 0 THEN CASE WHEN n1 = 1 THEN l1 END WHEN n2 > 0 THEN CASE WHEN n2 = 1 THEN l2 END WHEN n3 = 1 THEN l3 END AS lid FROM c4) "
    "SELECT file_name, matching_key, n AS n_candidates, g.tablet_no AS matched_tablet_no FROM m LEFT JOIN ledger g ON m.lid = g.lid",
    "ambiguous_forms": _PLAIN + "SELECT file_name, matching_key, n FROM j WHERE n > 1",
    "unmatched_forms": _PLAIN + "SELECT file_name FROM j WHERE n = 0",
    "field_diffs": _PLAIN + "SELECT file_name, label AS field, form_value, csv_value FROM (" + _unpivot("未読取", True) + ")",
    "reconcile_full": _BASE + "SELECT " + _named(["file_name", "matching_key", *(f"帳票_{c}" for c in _SEVEN), *(f"CSV_{c}" for c in _SEVEN), "status", "differences", "review_reasons"]) + " FROM res",
    "reconcile_export": _BASE + "SELECT " + _named(["ファイル", "マッチング方式", *(f"帳票_{c}" for c in _SHORT), *(f"CSV_{c}" for c in _SHORT), "ステータス", "差分内容", "確認理由"]) + " FROM res",
    "reconcile_pdf_mode": f"WITH {_PAGES}, {_TYPED}, {_PDF_FORMS}, {LEDGER}, {_EXACT}, {_COUNTED}, {_MATCHED}, {_JOINED}, {_DIFFS}, {_results(True)} SELECT seq AS page_id, file_name, matching_key, status, review_reasons FROM res",
    "status_counts": _BASE + "SELECT s.status, count(res.status) AS n FROM (VALUES ('一致'), ('不一致'), ('要確認')) s(status) LEFT JOIN res ON res.status = s.status GROUP BY 1",
    "kpi_cards": _BASE + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{k}, {_share(s)} AS pct_{k}" for k, s in (("match", "一致"), ("mismatch", "不一致"), ("review", "要確認"))) + " FROM res",
    "success_metrics": _BASE
    + "SELECT count(*) AS total, count(*) FILTER (status <> '要確認') AS report_matched, count(*) FILTER (matching_key <> '見つかりませんでした' AND NOT contains(matching_key, '複数候補')) AS auto_identified, "
    "count(*) FILTER (lid IS NOT NULL OR starts_with(matching_key, '複合キー')) AS candidate_found, count(*) FILTER (matching_key <> '見つかりませんでした') AS runner_success FROM res",
    "status_by_key": _BASE + "SELECT matching_key, status, count(*) AS n FROM res GROUP BY ALL",
    "report_items": _BASE + f"SELECT status, row_number() OVER (PARTITION BY {_RANK} ORDER BY seq, file_name) AS item_no, file_name, matching_key FROM res",
    "result_table": _BASE + "SELECT " + ", ".join(f"{_either(c, '-')} AS {n}" for n, c in _TABLE.items()) + " FROM res",
    "detail_unpivot": _PLAIN + "SELECT file_name, label, form_value, csv_value FROM (" + _unpivot("-", False) + ")",
    "store_status_summary": _BASE + "SELECT store_name, status, count(*) AS n FROM res GROUP BY ALL",
    "correction_rows": _BASE
    + "SELECT 対象日, 店舗名, 担当者名, 修正対象項目, 修正候補値, '未確認' AS 確認状態 FROM ("
    + " UNION ALL ".join(f"SELECT g_date AS 対象日, g_store_name AS 店舗名, g_staff_name AS 担当者名, '{label}' AS 修正対象項目, {_either(form, '未読取')} AS 修正候補値 FROM res WHERE status = '不一致' AND {differs}" for label, form, _, differs in _FIELDS)
    + ")",
    "parse_responses": f"WITH {_PAGES} SELECT page_id, date, store, name, data_no, tab_no, notes, coalesce(is_error, false) AS is_error FROM pages",
    "normalize_extractions": f"WITH {_PAGES}, {_TYPED} SELECT page_id, date, store, name, data_no, tab_no, count, total, notes, left_total, right_total FROM typed",
    "engine_b_match": f"WITH {_PAGES}, {_TYPED}, {_B_FORMS}, {LEDGER}, {_TRIMMED}, "
    + _counted("bf", "f.a", "f.b", ["f.date", "f.store", "f.name"])
    + f", {_B_PICK}, {_B_JOIN} SELECT page_id, match_key, CASE WHEN lid IS NULL THEN '要確認' WHEN {_B_DIFF} <> '' THEN '不一致' ELSE '一致' END AS status, count AS extracted_count, csv_count, {_B_DIFF} AS diff_text FROM bj",
    "page_statuses": f"WITH {_PAGES}, {_TYPED} SELECT page_id, printf('page_%02d', page_number) AS page_name, {_STATUS} AS status FROM typed",
    "page_success_ratio": f"WITH {_PAGES}, {_TYPED} SELECT count(*) FILTER ({_STATUS} = '[OK] Success') AS ok, count(*) AS total FROM typed",
    "preview_head": f"SELECT record_id, {', '.join(_LEDGER)} FROM ledger_records ORDER BY record_id, {', '.join(f'{c} NULLS FIRST' for c in _LEDGER)} LIMIT 5",
}
