"""Queries of the core operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.text import blank, join_list, list_repr, norm_tablet
from tallyloom.operators import metrics as M
from tallyloom.operators.copies import compare_copies
from tallyloom.operators.count_match import match_counts
from tallyloom.operators.diff import totals_agree
from tallyloom.operators.extract import normalize_extraction, page_name, page_rows, page_status, page_success, parse_response, to_forms
from tallyloom.operators.match import cascade, count_candidates, unmatched
from tallyloom.operators.packed import explode_packed
from tallyloom.plans import core_sql
from tallyloom.plans import reconcile as R
from tallyloom.sinks.writers import write_csv
from tallyloom.sources.readers import read_csv, read_forms, read_ledger
from tallyloom.tables import shared_path, table


def p3_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pairs of copies compared field by field, with the values."""
    ledger = compare_copies(table(spark, sf_dir, "ledger_records"), table(spark, sf_dir, "ledger_mirror"), "record_id", "modified_at")
    results = compare_copies(table(spark, sf_dir, "recon_results"), table(spark, sf_dir, "recon_mirror"), "file_name", "run_at")
    return ledger.select(F.lit("ledger").alias("dataset"), "*").unionAll(results.select(F.lit("results").alias("dataset"), "*"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing rows and differing fields of the two ledgers and the two result stores."""
    return p3_differences(spark, sf_dir).select("dataset", "row_key", "kind", "field")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers packed in the totals of every reading."""
    found = explode_packed(table(spark, sf_dir, "form_readings"), "reading_id", "left_totals", "right_totals")
    return found.select("reading_id", "field", F.col("pos").cast("int").alias("pos"), "item")


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_forms(table(spark, sf_dir, "form_readings"), "reading_id")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_ledger(table(spark, sf_dir, "ledger_records"))


def _results(spark: SparkSession, sf_dir: str, mode: str = "csv") -> DataFrame:
    return R.reconcile(_forms(spark, sf_dir), _ledger(spark, sf_dir), mode)


def _with_found(results: DataFrame) -> DataFrame:
    return results.withColumn("CSV_found", F.col("r").isNotNull())


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_response(table(spark, sf_dir, "page_responses"), "response_text")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_extraction(_pages(spark, sf_dir))


def forms_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms as read: keys, joined totals, flag."""
    return _forms(spark, sf_dir).select("file_name", *S.KEYS, join_list(F.col("left_totals")).alias("left_totals"), join_list(F.col("right_totals")).alias("right_totals"), "needs_review")


def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows as read, with joined totals."""
    return _ledger(spark, sf_dir).select(*S.KEYS, F.array_join(F.array(*S.LEFT), "/").alias("left_totals"), F.array_join(F.array(*S.RIGHT), "/").alias("right_totals"))


def tablet_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tablet texts of the forms with their form for matching."""
    return table(spark, sf_dir, "form_readings").select("tablet_no", norm_tablet(F.col("tablet_no")).alias("norm")).distinct()


def totals_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of left totals of a form, and the totals."""
    return _forms(spark, sf_dir).select("file_name", F.size("left_totals").cast("bigint").alias("n_left"), join_list(F.col("left_totals")).alias("left_joined"))


def _candidates(stage: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = count_candidates(_forms(spark, sf_dir), _ledger(spark, sf_dir), (stage,))
        return found.select("file_name", F.col(f"n_{stage}").alias("n_candidates"))

    query.__doc__ = f"Number of ledger rows with the form's {stage} key."
    return query


def cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stage decides for each form, and the row that was found."""
    found = cascade(_forms(spark, sf_dir), _ledger(spark, sf_dir))
    return found.select("file_name", "matching_key", "n_candidates", F.col("r.daily_report_no").alias("matched_daily_report_no"))


def cascade_fallthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where an ambiguous stage hands on to the next."""
    found = cascade(_forms(spark, sf_dir), _ledger(spark, sf_dir), "fallthrough", "trimmed")
    return found.select("file_name", F.col("stage").alias("match_key"), F.col("r.daily_report_no").alias("matched_daily_report_no"))


def cascade_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where several rows by number are narrowed by tablet."""
    found = cascade(_forms(spark, sf_dir), _ledger(spark, sf_dir), "narrow")
    return found.select("file_name", "matching_key", "n_candidates", F.col("r.tablet_no").alias("matched_tablet_no"))


def ambiguous_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms for which the deciding stage has several rows."""
    found = cascade(_forms(spark, sf_dir), _ledger(spark, sf_dir)).where(F.col("n_candidates") > 1)
    return found.select("file_name", "matching_key", F.col("n_candidates").alias("n"))


def unmatched_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms without a row at any stage."""
    return unmatched(_forms(spark, sf_dir), _ledger(spark, sf_dir)).select("file_name")


def field_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing fields of the forms whose row was found."""
    return R.diff_rows(_results(spark, sf_dir)).select("file_name", "field", "form_value", "csv_value")


def reconcile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 19 columns of the result file."""
    return R.result_rows(_results(spark, sf_dir))


def reconcile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the headers of the download."""
    return R.export_rows(_results(spark, sf_dir))


def reconcile_pdf_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the reading model as forms, reconciled."""
    forms = to_forms(_extracted(spark, sf_dir), "file_name", "page_id")
    return R.reconcile(forms, _ledger(spark, sf_dir), "pdf").select(F.col("seq").alias("page_id"), "file_name", "matching_key", "status", F.array_join("review_reasons", " | ").alias("review_reasons"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by status, with zeros."""
    return M.status_counts(_results(spark, sf_dir))


def kpi_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, and count and whole per cent of each status."""
    return M.kpi_cards(_results(spark, sf_dir))


def success_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ways of counting success."""
    return M.success_metrics(_with_found(_results(spark, sf_dir)))


def status_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by matching key and status."""
    return M.status_by_key(_results(spark, sf_dir))


def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the report numbered within their status; identical resends follow one another."""
    return M.report_items(_results(spark, sf_dir))


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that is shown."""
    return R.table_view(_results(spark, sf_dir))


def detail_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and ledger values side by side, a row for each field."""
    return R.detail_rows(_results(spark, sf_dir)).select("file_name", "label", "form_value", "csv_value")


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw fields of the answers."""
    return _pages(spark, sf_dir).select("page_id", *[F.col(f"raw.{c}").alias(c) for c in ("date", "store", "name", "data_no", "tab_no", "notes")], (F.col("error").isNotNull()).alias("is_error"))


def normalize_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of the answers."""
    return _extracted(spark, sf_dir).select("page_id", "date", "store", "name", "data_no", "tab_no", "count", "total", "notes", "left_total", "right_total")


def engine_b_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against the ledger by the second engine; its two numbers are the first totals."""
    crm = table(spark, sf_dir, "ledger_records").select(
        F.col("date").alias("日付"), F.col("store_name").alias("店舗名"), F.col("staff_name").alias("氏名"), F.col("daily_report_no").alias("日報データNo"),
        F.col("tablet_no").alias("タブレットNo"), F.col("left_total_1").alias("件数"), F.col("right_total_1").alias("合計値"),
    )
    m = match_counts(_extracted(spark, sf_dir), crm)
    shown = F.array_join(F.transform("diffs", lambda d: F.concat(d["field"], F.lit(":"), d["extracted"].cast("string"), F.lit("/"), d["csv"].cast("string"))), " | ")
    return m.select("page_id", "match_key", "status", F.col("count").alias("extracted_count"), "csv_count", shown.alias("diff_text"))


def page_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each page."""
    return page_status(_extracted(spark, sf_dir)).select("page_id", page_name(F.col("page_number")).alias("page_name"), F.col("page_status").alias("status"))


def page_success_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are ok, and all."""
    return page_success(page_status(_extracted(spark, sf_dir)))


def preview_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five ledger rows by number; a preview is short by its nature."""
    rows = table(spark, sf_dir, "ledger_records").select("record_id", *S.LEDGER)
    return R.preview(rows, ["record_id", *S.LEDGER])


def store_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by store and status."""
    return M.summary_by(_results(spark, sf_dir), "store_name")


def correction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each field to be corrected."""
    return R.correction_rows(_results(spark, sf_dir))


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values with the mark of those whose quote or bracket has no partner."""
    found = explode_packed(table(spark, sf_dir, "form_readings"), "reading_id", "left_totals", "right_totals")
    return found.select("reading_id", "field", F.col("pos").cast("int").alias("pos"), "item", "malformed")


def triangle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first left total of a ledger row is also its first right total and the sum of the other left ones."""
    n = {c: F.col(c).try_cast("double") for c in [*S.LEFT, *S.RIGHT]}
    agree = totals_agree(n["left_total_1"], n["right_total_1"], F.array(n["left_total_2"], n["left_total_3"]))
    return table(spark, sf_dir, "ledger_records").select("record_id", agree.alias("agree"))


def report_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items in the order of the report, with the place of their status."""
    items = M.report_items(_results(spark, sf_dir))
    return M.in_order(items).select(M.status_rank(F.col("status")).alias("group_no"), "status", "item_no", "file_name")


def report_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the report with their shares to one decimal."""
    return M.report_shares(_results(spark, sf_dir))


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the console summary."""
    return M.summary_lines(_results(spark, sf_dir))


def point_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results at place 100 of the input, with their label; a point is what is asked for."""
    return R.point(_results(spark, sf_dir), 100).select("seq", "label", "matching_key")


def totals_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left totals of each form as the text of a list."""
    return _forms(spark, sf_dir).select("file_name", list_repr(F.col("left_totals")).alias("left_repr"))


def forms_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms written as CSV and read from there."""
    path = shared_path(spark)
    write_csv(table(spark, sf_dir, "form_readings").select(*S.FORM_TEXT), path)
    return read_forms(spark, path).select("file_name", *S.KEYS, join_list(F.col("left_totals")).alias("left_totals"), join_list(F.col("right_totals")).alias("right_totals"), "needs_review")


def ledger_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows written as CSV and read from there."""
    path = shared_path(spark)
    write_csv(table(spark, sf_dir, "ledger_records").select(*S.LEDGER), path)
    return read_ledger(spark, path).select(*S.LEDGER)


def results_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result file as it stands in CSV; blank cells are empty texts."""
    path = shared_path(spark)
    write_csv(R.result_rows(_results(spark, sf_dir)), path)
    return read_csv(spark, path, S.RESULT).select(*[blank(F.col(c)).alias(c) for c in S.RESULT])


def pages_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page file as it stands in CSV, ``filename`` as in the table."""
    path = shared_path(spark)
    write_csv(page_rows(_extracted(spark, sf_dir).withColumnRenamed("file_name", "filename")), path)
    return read_csv(spark, path, S.PAGE).select(*[blank(F.col(c)).alias(c) for c in S.PAGE])


_MATCHING = [cascade_match, cascade_fallthrough, cascade_narrow, ambiguous_forms, unmatched_forms, field_diffs, reconcile_full, reconcile_export, reconcile_pdf_mode]
_REPORTS = [status_counts, kpi_cards, success_metrics, status_by_key, report_items, result_table, detail_unpivot, store_status_summary, correction_rows, report_ordered, report_shares, summary_lines, point_result]
_READING = [forms_scan, ledger_scan, tablet_normalize, totals_parse, parse_responses, normalize_extractions, engine_b_match, page_statuses, page_success_ratio, preview_head, triangle_check, totals_repr]
_FILES = [forms_csv_roundtrip, ledger_csv_roundtrip, results_csv_roundtrip, pages_csv_roundtrip]
QUERIES = {f.__name__: f for f in [p3_found, p5_found, p5_flags, *_READING, *_MATCHING, *_REPORTS, *_FILES]} | {
    "match_data_no": _candidates("number"), "match_tablet_no": _candidates("tablet"), "match_composite": _candidates("composite"),
}


def _copies_sql(dataset: str, first: str, second: str, key: str, version: str, texts: list[str], arrays: list[str]) -> str:
    """The comparison of two copies as one SELECT."""
    norm = {c: f"trim(coalesce(\"{c}\", ''), ' ')" for c in texts}
    norm |= {c: f"array_to_string(list_sort(list_distinct(coalesce(\"{c}\", []))), chr(31))" for c in arrays}
    cols = ", ".join(f'{e} AS "{c}"' for c, e in norm.items())
    order = ", ".join(f'"{c}" DESC' for c in norm)

    def latest(t: str) -> str:
        return (
            f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC NULLS LAST, {order}) AS rn "
            f"FROM (SELECT CAST({key} AS VARCHAR) AS k, {version} AS v, {cols} FROM {t})) WHERE rn = 1)"
        )

    joined = f"{latest(first)} a FULL OUTER JOIN {latest(second)} b ON a.k = b.k"
    parts = [f"SELECT '{dataset}' AS dataset, a.k AS row_key, 'only_first' AS kind, '' AS field FROM {latest(first)} a ANTI JOIN {latest(second)} b ON a.k = b.k"]
    parts += [f"SELECT '{dataset}', b.k, 'only_second', '' FROM {latest(second)} b ANTI JOIN {latest(first)} a ON a.k = b.k"]
    pairs = ", ".join(f"CASE WHEN a.\"{c}\" <> b.\"{c}\" THEN '{c}' END" for c in norm)
    parts += [f"SELECT '{dataset}', k, 'differs', field FROM (SELECT a.k AS k, unnest([{pairs}]) AS field FROM {joined} WHERE a.k IS NOT NULL AND b.k IS NOT NULL) WHERE field IS NOT NULL"]
    return " UNION ALL ".join(parts)


_LEDGER = ["date", "store_name", "staff_name", "daily_report_no", "tablet_no", "left_total_1", "left_total_2", "left_total_3", "right_total_1", "right_total_2"]
_SEVEN = ["date", "store_name", "staff_name", "daily_report_no", "tablet_no", "left_totals", "right_totals"]
_RESULT = ["matching_key", *(f"帳票_{c}" for c in _SEVEN), *(f"CSV_{c}" for c in _SEVEN), "status"]

SQL = dict(core_sql.SQL) | {
    "p3_found": _copies_sql("ledger", "ledger_records", "ledger_mirror", "record_id", "modified_at", _LEDGER, [])
    + " UNION ALL "
    + _copies_sql("results", "recon_results", "recon_mirror", "file_name", "run_at", _RESULT, ["differences", "review_reasons"]),
}
