"""Sources and sinks: pages with errors of their own, encodings, page files, the Markdown report, and shared folders."""

import pytest

from tallyloom import schema as S
from tallyloom import tables
from tallyloom.operators.count_match import match_counts
from tallyloom.operators.extract import normalize_extraction, page_rows, page_status, parse_response
from tallyloom.operators.metrics import in_order, report_items, report_shares
from tallyloom.plans import reconcile as R
from tallyloom.sinks import writers as W
from tallyloom.sources.readers import explode_pages, read_csv, read_ledger
from tallyloom.sources.sample import load_pages, load_sample


@pytest.fixture(scope="module")
def results(spark):
    return R.reconcile(*load_sample(spark)).cache()


def test_each_page_has_its_own_error(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one,bad,three")
    (tmp_path / "b.bin").write_bytes(b"one,stop")
    (tmp_path / "c.bin").write_bytes(b"")

    def split(content):
        for part in content.split(b",") if content else []:
            if part == b"stop":
                raise ValueError("no such page")
            yield part

    def extract(page, name):
        if page == b"bad":
            raise RuntimeError("unreadable")
        return f"{name} {page.decode()}"

    rows = {(r.filename, r.page_number): (r.page_name, r.response_text, r.error) for r in explode_pages(spark, str(tmp_path), split, extract).collect()}
    assert rows == {
        ("a.bin", 1): ("page_01", "page_01 one", None), ("a.bin", 2): ("page_02", None, "unreadable"), ("a.bin", 3): ("page_03", "page_03 three", None),
        ("b.bin", 1): ("page_01", "page_01 one", None), ("b.bin", 2): ("page_02", None, "no such page"),
    }


def test_other_encodings_are_refused(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes((",".join(S.LEDGER) + "\n" + ",".join(["店"] * 10) + "\n").encode("cp932"))
    with pytest.raises(ValueError):
        read_ledger(spark, str(tmp_path / "l.csv"))
    assert "�" in read_csv(spark, str(tmp_path / "l.csv"), S.LEDGER, strict=False).first().date


def test_page_file(spark, tmp_path):
    pages = spark.createDataFrame([(1, "s", ["a", "b"], [], None), (2, None, None, ["c"], "e")], "page_number INT, store STRING, left_totals ARRAY<STRING>, right_totals ARRAY<STRING>, error STRING")
    rows = page_rows(pages).orderBy("page_number").collect()
    assert (rows[0].left_totals, rows[0].right_totals, rows[0].error, rows[0].date) == ("['a', 'b']", "", "", "")
    assert (rows[1].store, rows[1].left_totals, rows[1].right_totals) == ("", "", "['c']")
    W.write_pages(pages, str(tmp_path / "p.csv"))
    assert "\"['a', 'b']\"" in (tmp_path / "p.csv").read_text(encoding="utf-8")


def test_sample_pages(spark):
    pages, crm = load_pages(spark)
    got = {r.page_id: r for r in match_counts(normalize_extraction(parse_response(pages, "response_text")), crm).collect()}
    assert [got[i].status for i in range(1, 5)] == [S.MATCH, S.MISMATCH, S.MATCH, S.REVIEW] and got[3].match_key == "tab_no"
    assert [r.page_status[:4] for r in page_status(normalize_extraction(parse_response(pages, "response_text"))).orderBy("page_id").collect()] == ["[OK]", "[OK]", "[WAR", "[WAR"]


def test_markdown_has_both_sides(results, tmp_path):
    W.write_markdown(results, str(tmp_path / "out" / "r.md"))
    text = (tmp_path / "out" / "r.md").read_text(encoding="utf-8")
    assert text == W.markdown_report(results)
    assert "### 一致（11件）" in text and "### 不一致（4件）" in text and "### 要確認（2件）" in text and "- **マッチング成功**: 15 / 17 件（88.2%）" in text
    item = text[text.index("report_02.pdf") : text.index("report_03.pdf")]
    assert "**帳票側**" in item and "- 左下合計: 30/8/3" in item and "- 左下合計: 30/8/2" in item and "- 左下合計欄: 帳票=30/8/3, CSV=30/8/2" in item
    assert "**CSV側**: マッチなし" in text[text.index("task_1.pdf") :]
    assert "0.0%" in W.markdown_report(results.limit(0))


def test_report_order_and_shares(results):
    rows = in_order(report_items(results)).collect()
    assert [(r.status, r.item_no) for r in rows] == [(S.MATCH, i) for i in range(1, 12)] + [(S.MISMATCH, i) for i in range(1, 5)] + [(S.REVIEW, 1), (S.REVIEW, 2)]
    assert {r.label: r.share for r in report_shares(results).collect()} == {"計": "100.0", S.MATCH: "64.7", S.MISMATCH: "23.5", S.REVIEW: "11.8", S.MATCHED: "88.2", S.UNMATCHED: "11.8"}
    assert {r.share for r in report_shares(results.limit(0)).collect()} == {"0.0"}
    assert W.console_summary(results) == ["一致: 11 (64.7%)", "不一致: 4 (23.5%)", "要確認: 2 (11.8%)", "候補あり: 16/17 (94.1%)"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session())


def test_released_files_are_gone(spark):
    df = tables.materialize(spark.range(3))
    assert df.count() == 3
    tables.release(df, spark.range(1))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_scratch_keeps_what_is_asked_for(spark):
    with tables.scratch():
        gone = tables.materialize(spark.range(2))
        kept = tables.materialize(gone.where("id > 0"), keep=True)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(kept._written_to).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert kept.count() == 1 and not system.exists(path(gone._written_to))


def test_daily_counts_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyloom.streaming.forms import daily_counts

    rows = [(S.MATCH, "2026-01-01 10:00:00"), (S.MATCH, "2026-01-01 11:00:00"), (S.REVIEW, "2026-01-02 00:00:00"), (S.MATCH, "2026-06-01 00:00:00")]
    spark.createDataFrame(rows, "status STRING, at STRING").select("status", F.col("at").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("status STRING, at TIMESTAMP").parquet(str(tmp_path / "in"))
    q = daily_counts(stream, "at").writeStream.outputMode("append").format("memory").queryName("daily").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {(str(r.day)[:10], r.status): r.n for r in spark.table("daily").collect()} == {("2026-01-01", S.MATCH): 2, ("2026-01-02", S.REVIEW): 1}
