"""Linkage of readings without a number."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import linkage
from tallyloom.llm.linkage import LEVELS, day_of, estimate, link_records, posterior
from tests.llm.test_names import LEXICON

READING = "reading_id BIGINT, date STRING, store_name STRING, staff_name STRING, daily_report_no STRING, tablet_no STRING, left_totals STRING, right_totals STRING, d STRING, s STRING"
RECORD = "record_id BIGINT, date STRING, store_name STRING, staff_name STRING, daily_report_no STRING, tablet_no STRING, left_total_1 STRING, left_total_2 STRING, left_total_3 STRING, right_total_1 STRING, right_total_2 STRING, rid STRING"


def test_dates(spark):
    texts = ["2026-02-03", "2026/2/3", "20260203", "26.02.03", "R8.2.3", "令和8年2月3日", "2月3日", "２０２６年２月３日", "x", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    y, d = day_of(F.col("t"))
    rows = [(r.y, r.d) for r in df.select("i", y.alias("y"), d.alias("d")).orderBy("i").collect()]
    assert [r[1] for r in rows[:8]] == ["0203"] * 8 and [r[0] for r in rows[:6]] == ["2026"] * 6 and rows[6][0] is None and [r[1] for r in rows[8:]] == [None] * 3


def test_estimation_finds_planted_shares():
    rnd = np.random.default_rng(0)
    counts: dict = {}
    for _ in range(20_000):
        match = rnd.random() < 0.3
        p = tuple(int(rnd.random() > (0.9 if match else 0.1)) * (k - 1) for k in LEVELS.values())
        counts[p] = counts.get(p, 0) + 1
    share, m, u = estimate(sorted(counts.items()))
    assert abs(share - 0.3) < 0.02 and abs(m[0][0] - 0.9) < 0.03 and abs(u[0][0] - 0.1) < 0.03
    x = np.array([[0] * 7, [k - 1 for k in LEVELS.values()], [-1] * 7])
    post = posterior(x, share, m, u)
    assert post[0] > 0.99 and post[1] < 0.01 and abs(post[2] - share) < 1e-6


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(4)
    stores = ["前倉ガーデン西口店", "黒口プラザ3号店", "長橋ロードA館店"]
    staff = ["前倉久江", "黒口徹也", "岩木悠介", "長橋麻代", "前倉徹也", "黒口麻代"]
    records, readings, truth = [], [], {}
    for i in range(240):
        k = i % 6
        day, left, right = f"2026-0{1 + i // 40}-{1 + i % 28:02}", [str(rnd.randrange(10, 40)), str(rnd.randrange(12)), str(rnd.randrange(9))], [str(rnd.randrange(10, 30)), str(rnd.randrange(9))]
        records.append((i, day, stores[k // 2], staff[k], f"{i * 7:010}", f"{k}A~{1000000 + k}", *left, *right, "z"))
        if i % 3 == 0:
            name = {0: staff[k], 1: staff[k][:2] + "さん"}[rnd.randrange(2)]
            readings.append((i, day if i % 4 else day.replace("-", "/"), stores[k // 2] if i % 5 else None, name if i % 7 else staff[k], rnd.choice(["", None, "9999999999", f"{i * 7:010}"[-6:]]), f"{k}A~{1000000 + k}" if i % 2 else None, "/".join(left), "; ".join(right), "d", "s"))
            truth[i] = i
    readings += [readings[0], (5_000, None, None, None, None, None, None, None, "d", "s"), (5_001, "2026-01-01", stores[0], "前倉久江", "", None, "90/91/92", "93/94", "d", "s"), (None, *readings[0][1:])]
    readings.append((5_002, "2026-01-01", stores[0], "前倉久江", f"{7:010}", None, "", "", "d", "s"))  # a usable number
    return (spark.createDataFrame(readings, READING), spark.createDataFrame([*records, records[0]], RECORD), spark.createDataFrame([(s,) for s in stores], "store_name STRING"), truth)


def test_links(world):
    readings, records, stores, truth = world
    got = {r.reading_id: r.record_id for r in link_records(readings, records, stores, LEXICON).collect()}
    right = sum(got.get(k) == v for k, v in truth.items())
    assert right >= 0.95 * len(truth) and 5_000 not in got and 5_002 not in got and None not in got
    assert sum(k not in truth or truth[k] != v for k, v in got.items()) <= 0.05 * len(truth)


def test_empty_tables(world):
    readings, records, stores, _ = world
    assert link_records(readings.limit(0), records, stores, LEXICON).count() == 0
    assert link_records(readings, records.limit(0), stores, LEXICON).count() == 0


def test_a_reading_without_a_day_meets_its_record(world):
    """Right store, person and tablet, all but one of the totals, and no day and no number."""
    readings, records, stores, _ = world
    rows = [r for r in records.where("record_id % 3 = 1").orderBy("record_id").limit(12).collect()]
    lone = [
        (9_000 + r.record_id, None, r.store_name, r.staff_name, None, r.tablet_no, f"{r.left_total_1}/{r.left_total_2}/77{r.left_total_3}", f"{r.right_total_1}; {r.right_total_2}", "d", "s")
        for r in rows
    ]
    more = readings.unionByName(readings.sparkSession.createDataFrame(lone, READING))
    got = {r.reading_id: r.record_id for r in link_records(more, records, stores, LEXICON).collect()}
    assert sum(got.get(9_000 + r.record_id) == r.record_id for r in rows) >= 11


def test_hot_values_lose_no_pair(world, monkeypatch):
    """The same links, whether values are hot or not: also for readings with one agreeing total or none."""
    readings, records, stores, truth = world
    rows = records.where("record_id % 3 = 2").orderBy("record_id").limit(6).collect()
    lone = [(9_000 + r.record_id, r.date, r.store_name, r.staff_name, None, None, f"{r.left_total_1}/771/772", "", "d", "s") for r in rows[:3]]
    lone += [(9_000 + r.record_id, r.date, r.store_name, r.staff_name, None, None, "", "", "d", "s") for r in rows[3:]]
    more = readings.unionByName(readings.sparkSession.createDataFrame(lone, READING))
    plain = {r.reading_id: r.record_id for r in link_records(more, records, stores, LEXICON).collect()}
    monkeypatch.setattr(linkage, "PLAIN_ROWS", 0)
    hot = {r.reading_id: r.record_id for r in link_records(more, records, stores, LEXICON).collect()}
    assert sum(hot.get(9_000 + r.record_id) == r.record_id for r in rows) == 6
    assert sum(plain.get(k) != v for k, v in hot.items()) <= 1 and sum(hot.get(k) != v for k, v in plain.items()) <= 1
    assert sum(hot.get(k) == v for k, v in truth.items()) >= 0.95 * len(truth)


def test_equal_candidates_share_the_confidence(world):
    """A reading that two records describe alike goes to the least one, at a half at most; repeated states of one record don't count twice."""
    readings, records, stores, _ = world
    spark = readings.sparkSession
    r = records.where("record_id = 100").first()
    twin = spark.createDataFrame([(7_000, *tuple(r)[1:]), tuple(r)], RECORD)
    lone = spark.createDataFrame([(9_500, r.date, r.store_name, r.staff_name, None, r.tablet_no, f"{r.left_total_1}/{r.left_total_2}/{r.left_total_3}", f"{r.right_total_1}/{r.right_total_2}", "d", "s")], READING)
    one = {x.reading_id: x for x in link_records(readings.unionByName(lone), records, stores, LEXICON).collect()}[9_500]
    two = {x.reading_id: x for x in link_records(readings.unionByName(lone), records.unionByName(twin), stores, LEXICON).collect()}[9_500]
    assert (one.record_id, one.candidates) == (100, 1) and one.confidence > 0.9
    assert (two.record_id, two.candidates) == (100, 2) and 0.4 < two.confidence <= 0.5


def test_the_plan_decides_nothing(world, monkeypatch):
    """Links, confidence and candidates are the same whatever counts as hot: with a loan tablet in all stores, states of one record and a reading with two rows."""
    readings, records, stores, _ = world
    spark = readings.sparkSession
    loan = records.withColumn("tablet_no", F.when(F.col("record_id") % 4 == 1, "9Z~0000001").otherwise(F.col("tablet_no")))
    states = loan.where("record_id % 12 = 1").withColumn("right_total_2", F.lit("8"))
    twins = loan.where("record_id % 12 = 9").withColumn("record_id", F.col("record_id") + 7_000)
    rows = loan.where("record_id % 4 = 1").orderBy("record_id").limit(40).collect()
    lone = [(9_000 + r.record_id, r.date, None, None, None, r.tablet_no, f"{r.left_total_1}/{r.left_total_2}/{r.left_total_3}", f"{r.right_total_1}/{r.right_total_2}", "d", "s") for r in rows]
    lone += [(9_000 + r.record_id, r.date, r.store_name, None, None, r.tablet_no, f"{r.left_total_1}/{r.left_total_2}/{r.left_total_3}", "", "d", "s") for r in rows[:5]]
    more, ledger = readings.unionByName(spark.createDataFrame(lone, READING)), loan.unionByName(states).unionByName(twins)

    def links():
        return sorted((x.reading_id, x.record_id, x.candidates, round(x.confidence, 9)) for x in link_records(more, ledger, stores, LEXICON).collect())

    plain = links()
    monkeypatch.setattr(linkage, "PLAIN_ROWS", 0)
    assert links() == plain and len(plain) >= 80 and max(c for _, _, c, _ in plain) == 2
    monkeypatch.setattr(linkage, "HOT", 0.03)  # some are
    assert links() == plain


def _longest_method(df):
    """Bytes of the longest generated method of a plan."""
    import contextlib
    import io
    import re

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("codegen")
    return max((int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())), default=0)


def test_generated_methods_are_short_enough_to_be_compiled(spark, world):
    """The JVM interprets methods beyond 8,000 bytes, which made up a third of the job's time."""
    readings, records, _, _ = world
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dates = spark.range(9).select(F.concat(F.lit("2026-02-0"), F.col("id").cast("string")).alias("t"))
        assert _longest_method(dates.select(*day_of(F.col("t")))) < 8_000
        side = "record_id BIGINT, y STRING, d STRING, s STRING, p STRING, t STRING, n STRING, `left` ARRAY<STRING>, `right` ARRAY<STRING>, ls BIGINT, rs BIGINT, hot ARRAY<BIGINT>, shared BOOLEAN, single BOOLEAN"
        some = spark.range(9).select("id", *(F.from_json(F.concat(F.lit('{"n":"'), F.col("id").cast("string"), F.lit('"}')), side).alias(x) for x in "fg"))
        f, g = some.select("id", F.col("id").alias("rid"), "f"), some.select("id", "g")
        pairs = f.repartition(2, "id").hint("merge").join(g.repartition(2, "id"), "id").withColumn("single", F.lit(False))
        assert 0 < _longest_method(linkage._compare(pairs)) < 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("f, g, level, same", [
    (["20", "6", "3"], ["20", "6", "3"], 0, True), (["6", "20", "3"], ["20", "6", "3"], 1, True), (["5", "5", "3"], ["5", "3", "5"], 1, True), (["5", "5", "5"], ["5", "3", "2"], 2, False),
    (["5", "5", "3"], ["5", "2"], 2, False), (["9", "6", "3", "20"], ["20", "6", "1"], 1, False), (["9", "8", "7", "20", "20"], ["20", "6", "1"], 2, False), (["9"], ["8"], 3, False), ([], ["8"], -1, False), ([], [], -1, False),
])
def test_levels_of_totals(spark, f, g, level, same):
    side = "record_id BIGINT, y STRING, d STRING, s STRING, p STRING, t STRING, n STRING, `left` ARRAY<STRING>, `right` ARRAY<STRING>, shared BOOLEAN, single BOOLEAN"
    row = spark.createDataFrame([(1, (None,) * 7 + (f, [], False, True), (1,) + (None,) * 6 + (g, [], False, True), True)], f"rid BIGINT, f STRUCT<{side}>, g STRUCT<{side}>, single BOOLEAN")
    got = linkage._compare(row).first()
    assert linkage._levels(got.pattern) == (-1, -1, -1, -1, level, -1, -1) and got.sample == same


@pytest.mark.parametrize("f, g, level", [("0000000001", "0000000001", 0), ("0000000001", "0000000002", 1), ("0000000001", "0000000112", 2), ("0000000001", "0000111112", 3), ("00001", "0000000001", 1), ("000001", "00001", 1), ("0001", "0000000001", 3)])
def test_levels_of_numbers(spark, f, g, level):
    side = "record_id BIGINT, y STRING, d STRING, s STRING, p STRING, t STRING, n STRING, `left` ARRAY<STRING>, `right` ARRAY<STRING>, shared BOOLEAN, single BOOLEAN"
    row = spark.createDataFrame([(1, (None,) * 6 + (f, [], [], False, True), (1,) + (None,) * 5 + (g, [], [], False, True), True)], f"rid BIGINT, f STRUCT<{side}>, g STRUCT<{side}>, single BOOLEAN")
    assert linkage._levels(linkage._compare(row).first().pattern) == (-1,) * 6 + (level,)


def test_plain_totals_are_read_as_the_grammar_reads_them(spark):
    texts = ["20/6/3", "7", "20/6/", "/6", "20//3", "20/6/3\n", "1.5/2", "1,234/5", "２０/6", " 20/6", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r[0] for r in df.orderBy("i").select(linkage._numbers(F.col("t"))).collect()]
    assert got == [r[0] for r in df.orderBy("i").select(linkage._numbers(F.concat(F.lit("\u200b"), F.col("t")))).collect()]  # a blank the short way doesn't know
    assert got[:3] == [["20", "6", "3"], ["7"], ["20", "6"]]
