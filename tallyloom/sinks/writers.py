"""Result files: CSV with CRLF, JSON lines, and the Markdown report."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.operators.extract import page_rows
from tallyloom.operators.metrics import kpi_cards, percent_text, status_rank, summary_lines
from tallyloom.plans.reconcile import export_rows, result_rows

_OPTIONS = {"header": True, "emptyValue": "", "nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\r\n", "encoding": "UTF-8"}


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts as the executors hold them: UTF-8, CRLF, quotes only where needed, blank for null."""
    df.write.mode("overwrite").options(**_OPTIONS).csv(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file on the driver's disk, streamed partition by partition; for exports that a person opens."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def write_results(results: DataFrame, path: str) -> None:
    """The 19-column result file in input order."""
    write_csv_file(result_rows(results.orderBy("seq")), path)


def write_export(results: DataFrame, folder: str, at: datetime | None = None) -> str:
    """The download, named by its time; gives the path."""
    path = f"{folder}/reconciliation_result_{at or datetime.now():%Y%m%d_%H%M%S}.csv"
    write_csv_file(export_rows(results.orderBy("seq")), path)
    return path


def write_pages(pages: DataFrame, path: str) -> None:
    """The page file with its 13 columns; lists as ``['a', 'b']``, null and absent columns blank."""
    write_csv_file(page_rows(pages), path)


def write_json(results: DataFrame, path: str) -> None:
    """Results with their nested fields as JSON lines."""
    results.write.mode("overwrite").json(path)


def _sides(r: Row) -> Iterator[str]:
    """The values of a form, and of its ledger row."""
    yield "**帳票側**\n"
    yield from (f"- {label}: {value or S.UNREAD}" for label, value in zip(S.REPORT_FIELDS, [r[c] for c in S.KEYS] + ["/".join(r[c] or []) for c in ("left_totals", "right_totals")], strict=True))
    if r.r is None:
        yield "\n**CSV側**: マッチなし"
        return
    yield "\n**CSV側**\n"
    row = [r.r[c] for c in S.KEYS] + ["/".join(r.r[c] or "" for c in part) for part in (S.LEFT, S.RIGHT)]
    yield from (f"- {label}: {value or ''}" for label, value in zip(S.REPORT_FIELDS, row, strict=True))


def markdown_lines(results: DataFrame, title: str = "照合結果レポート") -> Iterator[str]:
    """Counts, shares, and every item by status in input order with both sides, differences and reasons.

    The counts are one aggregate; the items come to the driver one partition at a time and are handed on at once.
    No results: the counts only, all shares 0.0.
    """
    k = kpi_cards(results).first()
    counts = {S.MATCH: k.n_match, S.MISMATCH: k.n_mismatch, S.REVIEW: k.n_review}
    yield from (f"# {title}", "", "## 概要", "", f"**対象件数**: {k.total} 件", "", "| ステータス | 件数 | 割合 |", "|---|---|---|")
    yield from (f"| {label} | {n} | {percent_text(n, k.total)}% |" for label, n in counts.items())
    yield f"| **計** | **{k.total}** | **100%** |"
    yield ""
    for label, n in ((S.MATCHED, k.n_match + k.n_mismatch), (S.UNMATCHED, k.n_review)):
        yield f"- **{label}**: {n} / {k.total} 件（{percent_text(n, k.total)}%）"
    yield from ("", "## 詳細結果")
    status, number = None, 0
    for r in results.orderBy(status_rank(F.col("status")), "seq", "file_name").toLocalIterator():
        if r.status != status:
            status, number = r.status, 0
            yield from ("", f"### {status}（{counts[status]}件）")
        number += 1
        yield from ("", f"#### {number}. {r.file_name}", "", f"**マッチングキー**: {r.matching_key}", f"**ステータス**: {r.status}", "")
        yield from _sides(r)
        for head, texts in (("差分内容", r.differences), ("要確認理由", r.review_reasons)):
            if texts:
                yield f"\n**{head}**\n"
                yield from (f"- {t}" for t in texts)


def write_markdown(results: DataFrame, path: str, title: str = "照合結果レポート") -> None:
    """The Markdown report as one file on the driver's disk, written line by line."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in markdown_lines(results, title))


def markdown_report(results: DataFrame, title: str = "照合結果レポート") -> str:
    """The Markdown report as one text, for as many items as a person reads."""
    return "\n".join(markdown_lines(results, title)) + "\n"


def console_summary(results: DataFrame) -> list[str]:
    """Lines of the status counts in code point order and of the rows with a candidate."""
    return [r.line for r in summary_lines(results).orderBy("line_no").collect()]
