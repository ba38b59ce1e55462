"""Comparison of two copies."""

import random
from datetime import datetime

from tallyloom.operators.copies import compare_copies

SCHEMA = "id BIGINT, a STRING, b ARRAY<STRING>, at TIMESTAMP"


def t(n):
    return datetime(2026, 1, 1, n)


def found(first, second, **k):
    return sorted(tuple(r[c] for c in ("row_key", "kind", "field")) for r in compare_copies(first, second, "id", "at", **k).collect())


def test_cases(spark):
    first = spark.createDataFrame([
        (1, "x", ["p", "q"], t(1)), (2, " x ", None, t(1)), (3, None, [], t(1)), (4, "old", [], t(1)), (4, "new", [], t(2)), (4, "new", [], t(2)),
        (5, "29", [], None), (6, "only", [], t(1)), (None, "k", [], t(1)), (8, "長" * 100_000, ["m"], t(1)),
    ], SCHEMA)
    second = spark.createDataFrame([
        (1, "x", ["q", "p", "p"], t(9)), (2, "x", [], t(1)), (3, "", [None], t(1)), (4, "new", [], t(1)), (5, "29.0", [], None),
        (7, "only", [], t(1)), (None, "k2", [], t(1)), (8, "長" * 100_000, ["n"], t(1)),
    ], SCHEMA)
    got = {tuple(r[c] for c in ("row_key", "kind", "field")) for r in compare_copies(first, second, "id", "at").collect()}
    assert got == {("5", "differs", "a"), ("6", "only_first", ""), ("7", "only_second", ""), (None, "differs", "a"), ("8", "differs", "b")}
    values = {r.row_key: (r.first_value, r.second_value) for r in compare_copies(first, second, "id", "at").where("kind = 'differs'").collect()}
    assert values["5"] == ("29", "29.0") and values["8"] == ("m", "n")


def test_empty_and_extra_columns(spark):
    one, none = spark.createDataFrame([(1, "x", [], t(1))], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert found(one, none) == [("1", "only_first", "")] and found(none, one) == [("1", "only_second", "")] and found(none, none) == []
    odd = spark.createDataFrame([(1, "x", "y", "z")], "id BIGINT, s1 STRING, row_key STRING, `a.b` STRING")
    other = spark.createDataFrame([(1, "x2", "y", "z2", 0)], "id BIGINT, s1 STRING, row_key STRING, `a.b` STRING, more INT")
    rows = {r.field for r in compare_copies(odd, other, "id").collect()}
    assert rows == {"s1", "a.b"} and not compare_copies(odd, other, "id", ignore=("s1", "a.b")).collect()


def test_against_dictionaries(spark):
    rnd = random.Random(3)
    side = lambda: [(rnd.randrange(40), rnd.choice(["a", " a", "b", None, ""]), rnd.choice([None, [], ["x"], ["y", "x"], ["x", "y"]]), rnd.choice([None, t(1), t(2)])) for _ in range(80)]

    def latest(rows):
        out = {}
        for k, a, b, at in rows:
            v = (at is not None, at or t(0), (a or "").strip(" "), sorted(set(b or [])))
            out[k] = max(out.get(k, v), v)
        return {k: v[2:] for k, v in out.items()}

    one, two = side(), side()
    x, y = latest(one), latest(two)
    want = {(str(k), "only_first", "") for k in x.keys() - y.keys()} | {(str(k), "only_second", "") for k in y.keys() - x.keys()}
    want |= {(str(k), "differs", f) for k in x.keys() & y.keys() for f, p, q in zip("ab", x[k], y[k], strict=True) if p != q}
    assert set(found(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA))) == want
