"""Leaked passages against a brute-force search."""

import random

import pytest

from tallyloom.llm import leaks
from tallyloom.llm.leaks import RUN, build_index, find_leaks, letters, matched, search

WORDS = "棚卸し 催事場 巡回員 配送 応援員 封筒 組立図 荷札 会計 補助 看板 冷蔵庫 carpet ledger pencil harbour winter mirror".split()


def passage(rnd, n=40):
    return "".join(rnd.choice(WORDS) + str(rnd.randrange(100)) + rnd.choice(["、", "。", " ", "は"]) for _ in range(n))


def brute(docs, items, share=0.5, run=20):
    out = set()
    for d, text in docs:
        t = letters(text)
        for i, p in items:
            p = letters(p)
            mark = [False] * len(p)
            for a in range(len(p) - run + 1):
                if p[a : a + run] in t:
                    mark[a : a + run] = [True] * run
            if p and len(p) >= run and sum(mark) >= share * len(p):
                out.add((d, i))
    return out


def run_it(spark, docs, items, **k):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id BIGINT, text STRING, item STRING, pos INT")
    i = spark.createDataFrame([(a, b, "q") for a, b in items], "item_id BIGINT, passage STRING, text STRING")
    return {(r.doc_id, r.item_id) for r in find_leaks(d, "doc_id", "text", i, "item_id", "passage", **k).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    items = [(i, passage(rnd)) for i in range(12)]
    docs = []
    for d in range(80):
        body = passage(rnd, 20)
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(items)[1]
            for _ in range(rnd.choice([1, 2, 4])):
                a = rnd.randrange(len(p))
                piece = p[a : a + rnd.choice([25, 60, 150, 400])]
                body += rnd.choice(["\n", "……", "」"]) + piece.replace("。", rnd.choice(["。", " \n", "!!"])) + passage(rnd, 2)
        docs.append((d, body))
    want = brute(docs, items)
    assert 5 < len(want) < 80 * 12 and run_it(spark, docs, items) == want
    assert run_it(spark, docs, items, share=0.2) == brute(docs, items, 0.2)


def test_widths_case_order_and_edges(spark):
    p = "The carpet of harbour 12 was wound around a winter mirror, 雨脚が強まった午後に屋上の仮設受付で数え直した。"
    wide = "ＴＨＥ　ＣＡＲＰＥＴ　ＯＦ　ｈａｒｂｏｕｒ　１２ was\nwound… around “a winter mirror” 雨脚が強まった 午後に屋上の仮設受付で数え直した"
    half = len(letters(p)) // 2
    turned = letters(p)[half:] + "と" + letters(p)[:half]
    docs = [(1, wide), (1, wide), (2, turned), (3, None), (4, ""), (5, " "), (6, letters(p)[:19] * 3), (7, "x" * 300_000 + wide), (None, wide)]
    items = [(1, p), (2, p), (3, None), (4, ""), (5, "短い"), (None, p)]
    assert run_it(spark, docs, items) == {(d, i) for d in (1, 2, 7) for i in (1, 2)}
    assert run_it(spark, [], items) == set() and run_it(spark, docs, []) == set()


def test_short_runs_are_refused(spark):
    with pytest.raises(ValueError):
        run_it(spark, [(1, "a")], [(1, "b")], run=10)


def test_one_index_answers_several_sets(spark, monkeypatch):
    rnd = random.Random(8)
    sets = [[(i, passage(rnd)) for i in range(6)] for _ in range(2)]
    docs = []
    for d in range(40):
        p = rnd.choice(rnd.choice(sets))[1]
        a = rnd.randrange(len(p) // 2)
        docs.append((d, passage(rnd, 8) + p[a : a + rnd.choice([100, 300, 900])] + passage(rnd, 8)))
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    index = build_index(df, "doc_id", "text")
    for items in sets:
        for bound in (1_000_000, 0):  # terms sent to all, or joined
            monkeypatch.setattr(leaks, "BROADCAST_TERMS", bound)
            got = search(index, df, "doc_id", "text", spark.createDataFrame(items, "item_id BIGINT, passage STRING"), "item_id", "passage")
            assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items)


def test_ways_of_matching():
    rnd = random.Random(2)
    p = letters(passage(rnd))
    n, other = len(p), letters(passage(random.Random(9), 200))
    assert matched("x" + p + "y", p, RUN) == (n, n, n)
    assert matched(other, p, RUN)[0] == 0 and matched("", p, RUN) == (0, 0, 0) == matched(p, "", RUN)
    half = matched("ab" + p[: n * 2 // 3] + "cd", p, RUN)
    assert half[:2] == (n * 2 // 3, n * 2 // 3)
    pieces = [p[i : i + 30] for i in range(0, n - 30, 30)]
    near, far = "#".join(pieces), other.join(pieces)
    assert matched(near, p, RUN)[0] == matched(far, p, RUN)[0] == 30 * len(pieces)
    assert matched(near, p, RUN)[2] > n / 2 > matched(far, p, RUN)[2] and matched(near, p, RUN)[1] == 30


def test_overlapping_runs(spark):
    """Runs that share letters of the passage: the least number of terms must not be asked too high."""
    rnd = random.Random(4)
    p = letters(passage(rnd, 12))
    docs = [(i, "#".join(p[a : a + w] for a in range(0, len(p) - w + 1, step)) + "@" + passage(rnd, 3)) for i, (w, step) in enumerate([(20, 1), (20, 7), (30, 10), (29, 9), (21, 13), (40, 20)])]
    assert run_it(spark, docs, [(1, p)]) == brute(docs, [(1, p)]) == {(i, 1) for i in range(6)}


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_only_terms_pass_through_the_driver(spark, monkeypatch, bound):
    """Postings, passages and found pairs are joined by shuffles, however small their files are."""
    rnd = random.Random(6)
    items = [(i, passage(rnd)) for i in range(5)]
    docs = [(d, passage(rnd, 5) + rnd.choice(items)[1] + passage(rnd, 5)) for d in range(20)]
    plans, materialize = [], leaks.materialize

    def noted(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *rest)

    monkeypatch.setattr(leaks, "materialize", noted)
    monkeypatch.setattr(leaks, "BROADCAST_TERMS", bound)
    df, asked = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, passage STRING")
    found = find_leaks(df, "doc_id", "text", asked, "item_id", "passage")
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(docs, items)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("BroadcastExchange") for p in plans) == (bound > 0)
