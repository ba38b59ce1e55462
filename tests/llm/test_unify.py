"""Unification of look-alike text."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import unify
from tallyloom.llm.unify import BUILT_IN, MARKS, _segments, _tools, find_disguised, kana_runs, make_unifier, needs_unifying, published_table

LEXICON = [("surname", "夕口", "ユウグチ", "Yuuguchi", None), ("surname", "水口", "ミズグチ", "Mizuguchi", None), ("surname", "上浦", "カミウラ", "Kamiura", None), ("surname", "夕岡", "ユウオカ", "Yuuoka", None), ("given", "隆代", "タカヨ", "Takayo", "タカ")]
UNIFY = make_unifier([r[1] for r in LEXICON if r[0] == "surname"], [w for r in LEXICON for w in (r[2], r[4]) if w])

CASES = {
    "９Ｚ～００００００１": "9Z~0000001",
    "5В~2700396": "5B~2700396",
    "4​S~0665213": "4S~0665213",
    "1S~0293020　": "1S~0293020",
    "3X˜1512546": "3X~1512546",
    "2N~060978𝟶": "2N~0609780",
    "長橋ﾛｰﾄﾞA館店": "長橋ロードA館店",
    "杉川夕ーミナル第三店": "杉川ターミナル第三店",
    "赤原デパ─卜本店": "赤原デパート本店",
    "上浦夕ウン特設店": "上浦タウン特設店",
    "東島ぺアシティ4F店": "東島ペアシティ4F店",
    "イべント": "イベント",
    "広根フロ A館店": "広根フロ A館店",
    "松浜 Ѕоuth店": "松浜 South店",
    "⼣岡プラザ": "夕岡プラザ",
    "パーク": "パーク",
    "夕カさん": "タカさん",
    "西ロ店": "西口店",
}
CLEAN = ["水口ロード", "夕口タウン", "夕口・翔美", "プラザ夕岡3号店", "第一店", "櫻口隆司", "長橋ード", "松林・葉一", "ツシ", "", "9Z~0000001", "Annex店", "二三四", "センター", "山一証券"]


@pytest.mark.parametrize(("text", "want"), CASES.items())
def test_cases(text, want):
    assert UNIFY(text) == want and UNIFY(want) == want


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert UNIFY(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("アタロー夕口一二カ力山A1 （）ｱﾞВ​　é゙"), max_size=12))
def test_result_is_stable_and_composed(text):
    once = UNIFY(text)
    assert UNIFY(once) == once
    assert unicodedata.is_normalized("NFC", once) and once == once.strip(" ")


def test_quick_check_misses_nothing(spark):
    texts = [*CASES, *CLEAN, "青浦 工ちゃん", " a", "a ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "v STRING").select("v", needs_unifying(F.col("v")).alias("q")).collect()
    for r in rows:
        if r.v is not None and UNIFY(r.v) != r.v:
            assert r.q, r.v


def test_operator(spark):
    lexicon = spark.createDataFrame(LEXICON, "name_kind STRING, kanji STRING, kana STRING, romaji STRING, called_as STRING")
    df = spark.createDataFrame([
        (1, "長橋ﾛｰﾄﾞ", "夕カさん", "x"), (1, "長橋ﾛｰﾄﾞ", "夕カさん", "y"), (2, None, "", "x"), (3, "　", "水口", "x"), (None, "Ａ", None, "x"), (4, "長" * 60_000 + "Ａ", "ok", "x"),
    ], "id BIGINT, store STRING, staff STRING, value STRING")
    rows = {(r.row_id, r.field): r.canonical for r in find_disguised(df, "id", ["store", "staff"], lexicon, "t").collect()}
    assert rows == {(1, "store"): "長橋ロード", (1, "staff"): "タカさん", (3, "store"): "", (None, "store"): "A", (4, "store"): "長" * 60_000 + "A"}
    assert find_disguised(df, "id", ["store", "staff"], lexicon, "t").count() == 5
    assert find_disguised(df.limit(0), "id", ["store"], lexicon, "t").count() == 0
    assert find_disguised(df, "id", ["store"], lexicon.limit(0), "t").count() == 4


def test_published_letters(spark):
    """Letters of any script that look like Latin ones, and radicals that look like kanji; nothing of them passes the quick check."""
    table = published_table(spark)
    unify = make_unifier((), (), table)
    for text, want in {"Ꭺ": "A", "օk": "ok", "ꓮB": "AB", "ɴo": "No", "⻁": "虎", "Ѵic": "Vic", "か゛": "が", "ガ": "ガ", "4А~1": "4A~1"}.items():
        assert unify(text) == want, text
    for text in ("кириллица", "Ελλάδα", "Ünïcödé", "김민수", "口座"):
        assert unify(text) == text
    letters = [(c,) for c in table[0] + "".join(MARKS)]
    assert spark.createDataFrame(letters, "c STRING").where(~needs_unifying(F.col("c"))).count() == 0


def test_only_unstable_segments_change():
    """A segment is no more than the unstable characters and the starter that they join."""
    text = "前倉" * 50 + "ﾊﾟ" + "。" * 50 + "é" + "x"
    _, kinds = _tools(BUILT_IN)
    assert [text[a:b] for a, b in _segments(text, kinds)] == ["ﾊﾟ", "é"]
    assert UNIFY(text) == "前倉" * 50 + "パ" + "。" * 50 + "éx"


def test_every_kana_word_of_the_places_counts(spark, monkeypatch):
    """However rare a word is, and however many there are, it decides on the look-alikes in it."""
    monkeypatch.setattr(unify, "WORDS", 1, raising=False)
    words = ["タウン", "プラザ", "エニ", *("".join("アイウオキクケコサシ"[int(x)] for x in str(i)) for i in range(10, 3_000))]
    stores = spark.createDataFrame([(f"前倉{w}{i}号店",) for w in words for i in range(1 + 2 * (w == "タウン"))] + [(None,), ("",)], "store_name STRING")
    found = kana_runs(stores, "store_name")
    assert set(found) == set(words) and all(w in found for w in words)
    assert not any(w in found for w in ("", "ア", "ン", "ヺヺ", "エニエ", "A"))
    lexicon = spark.createDataFrame(LEXICON, "name_kind STRING, kanji STRING, kana STRING, romaji STRING, called_as STRING")
    df = spark.createDataFrame([(1, "工ニ"), (2, "工二")], "id BIGINT, store STRING")
    assert {r.row_id: r.canonical for r in find_disguised(df, "id", ["store"], lexicon, "t", found).collect()}[1] == "エニ"
    none = kana_runs(stores.limit(0), "store_name")
    assert list(none) == [] and "エニ" not in none
