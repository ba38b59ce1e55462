"""Splitting of packed values against a parser written by hand."""

import random
import unicodedata

import pytest

from tallyloom.operators.packed import BRACKETS, QUOTES, explode_packed

CASES = {
    "25; 8; 3": [(1, "25"), (2, "8"), (3, "3")],
    "17/6": [(1, "17"), (2, "6")],
    '"25" / "" / "9"': [(1, "25"), (3, "9")],
    "9;8 3": [(1, "9"), (2, "8"), (3, "3")],
    "19.3/4": [(1, "19.3"), (2, "4")],
    "19　5　3": [(1, "19"), (2, "5"), (3, "3")],
    "{15|'3,7'}": [(1, "15"), (2, "3,7")],
    "{“”/“7”；“1”/}": [(2, "7"), (3, "1")],
    '"33"／ "6";"3"': [(1, "33"), (2, "6"), (3, "3")],
    "19・9\n6": [(1, "19"), (2, "9"), (3, "6")],
    "75 | 11；“2(要;確認)”": [(1, "75"), (2, "11"), (3, "2(要;確認)")],
    "/9/9": [(2, "9"), (3, "9")],
    "15::2": [(1, "15"), (3, "2")],
    "24／ ／ 1": [(1, "24"), (3, "1")],
    '"21 本"｜"10"': [(1, "21 本"), (2, "10")],
    " 9 / 9 ": [(1, "9"), (2, "9")],
    "　(“18(訂正)”，“4”) ": [(1, "18(訂正)"), (2, "4")],
    "9\t \t8": [(1, "9"), (2, "8")],
    '" 5 ",6': [(1, "5"), (2, "6")],
    '"5/6': [(1, "5"), (2, "6")],
    "": [], " 　": [], "()": [], "/": [], '""': [],
    "9-8": [(1, "9"), (2, "8")],
    'a""b': [(1, 'a""b')],
    '"a""b" 3': [(1, 'a"b'), (2, "3")],
}


def split(spark, texts):
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], "id BIGINT, a STRING, b STRING, malformed STRING")
    out = {i: [] for i in range(len(texts))}
    for r in explode_packed(df, "id", "a", "b").collect():
        assert r.field == "a"
        out[r.id].append((r.pos, r.item))
    return [sorted(v) for v in out.values()]


def test_cases(spark):
    assert dict(zip(CASES, split(spark, list(CASES)), strict=True)) == CASES


def is_mark(c):
    return unicodedata.category(c)[0] in "PS" and c not in "%％" and c not in "".join(map("".join, QUOTES + BRACKETS)) and unicodedata.category(c) != "Sc"


def by_hand(text):
    """Character by character; for texts whose quotes and brackets close."""
    text = text.strip()
    if text and (text[0], text[-1]) in BRACKETS:
        text = text[1:-1]
    items, at, n = [], 0, len(text)
    while True:
        while at < n and text[at].isspace():
            at += 1
        value = ""
        quote = next((b for a, b in QUOTES if at < n and text[at] == a), None)
        if quote:
            end = text.index(quote, at + 1)
            value, at = text[at + 1 : end], end + 1
        else:
            start = at
            while at < n and not text[at].isspace() and (not is_mark(text[at]) or text[at] == "." and text[at - 1 : at].isdigit() and text[at + 1 : at + 2].isdigit()):
                at += 1
            value = text[start:at]
        items.append(value.strip())
        while at < n and text[at].isspace():
            at += 1
        if at >= n:
            break
        if is_mark(text[at]):
            at += 1
            if at >= n:
                break
    return [(i, v) for i, v in enumerate(items, 1) if v]


def test_against_hand_parser(spark):
    rnd = random.Random(11)

    def value():
        v = rnd.choice(["", "1", "25", "3.5", "10", "7"])
        a, b = rnd.choice([("", ""), ("", ""), ('"', '"'), ("'", "'"), ("“", "”")])
        return a + (rnd.choice(["1,204", "2(要;確認)", "4 本", v]) if a else v) + b

    texts = []
    for _ in range(400):
        seps = [rnd.choice(["/", "；", ", ", " | ", "・", "-", "  ", "\t", "\n", "／ ", "　"]) for _ in range(4)]
        body = "".join(value() + s for s in seps[: rnd.randrange(4)]) + value()
        a, b = rnd.choice([("", ""), ("", ""), ("(", ")"), ("【", "】"), ("  ", " ")])
        texts.append(a + body + b)
    assert split(spark, texts) == [by_hand(t) for t in texts]


def test_repeats_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(1, "1/2", None), (1, "1/2", None), (None, "3", "4"), (2, "7;" * 20_000, "")], "reading_id BIGINT, l STRING, r STRING")
    rows = explode_packed(df, "reading_id", "l", "r").collect()
    assert sorted((r.field, r.pos, r.item) for r in rows if r.reading_id == 1) == [("l", 1, "1"), ("l", 2, "2")]
    assert {(r.field, r.item) for r in rows if r.reading_id is None} == {("l", "3"), ("r", "4")}
    assert sum(r.reading_id == 2 for r in rows) == 20_000
    assert explode_packed(df.limit(0), "reading_id", "l", "r").count() == 0


@pytest.mark.parametrize("text", ['"5', "'5'6'/7", '“3/4'])
def test_malformed_quotes_are_flagged(spark, text):
    df = spark.createDataFrame([(1, text)], "id BIGINT, a STRING")
    assert any(r.malformed for r in explode_packed(df, "id", "a").collect())
