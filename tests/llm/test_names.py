"""Names: keys that miss nothing, and spellings linked to persons."""

import random

from tallyloom.llm.names import Lexicon, core_of, index_keys, probe_keys, romaji, skeleton
from tallyloom.llm.people import components, link_spellings, spelling_classes, spelling_pairs
from tallyloom.llm.places import resolve_places

FIELDS = ("name_kind", "kanji", "kana", "romaji", "called_as")
LEXICON = [dict(zip(FIELDS, r, strict=True)) for r in [
    ("surname", "前倉", "マエクラ", "Maekura", None), ("surname", "黒口", "クログチ", "Kuroguchi", None), ("surname", "岩木", "イワキ", "Iwaki", None), ("surname", "岩本", "イワモト", "Iwamoto", None), ("surname", "長橋", "ナガハシ", "Nagahashi", None),
    ("given", "久江", "ヒサエ", "Hisae", "ヒサ"), ("given", "久人", "ヒサト", "Hisato", "ヒサ"), ("given", "徹也", "テツヤ", "Tetsuya", "テツ"), ("given", "悠介", "ユウスケ", "Yuusuke", "ユウ"), ("given", "麻代", "アサヨ", "Asayo", "アサ"),
]]


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_segments_find_every_near_text():
    rnd = random.Random(1)
    for _ in range(3_000):
        k = rnd.choice([0, 1, 2])
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(k + 1, 9)))
        b = list(a)
        for _ in range(k):
            at = rnd.randrange(len(b) + 1)
            rnd.choice([lambda: b.insert(at, rnd.choice("abc")), lambda: b.__delitem__(slice(at, at + 1)), lambda: b.__setitem__(slice(at, at + 1), [rnd.choice("abc")])])()
        b = "".join(b)
        if b and plain_distance(a, b) <= k:
            assert set(index_keys(a, k)) & set(probe_keys(b, k)), (a, b, k)


def test_cores():
    assert romaji("シュンイチ") == "shunichi" and romaji("ジュンヤ") == "junya" and skeleton("Nisikawa Hideiti") == skeleton("Nishikawa Hideichi")
    for text in ("前倉久江", "前倉 久江", "前倉・久江", "副店長 前倉久江", "担当:前倉久江", "前倉久江さん", "前倉久江(早番)", "前倉久江様"):
        assert core_of(text)[0] == "前倉久江", text
    assert core_of("カズくん")[0] == "カズ" and core_of("小坂もえちゃん")[0] == "小坂モエ" and core_of("下浦(里)")[0] == "下浦里" and core_of("霧口恵.")[0] == "霧口恵"
    assert core_of("新林主任")[0] == "新林" and core_of("")[0] == ""


def people(spark, rows):
    df = spark.createDataFrame(rows, "store STRING, staff STRING, person STRING, place STRING")
    return {(r.place, r.written): r.person for r in link_spellings(df, "store", "staff", LEXICON).collect()}


def test_spellings_of_a_store(spark):
    hisae = ["前倉久江", "前倉　久江", "久江 前倉", "前倉さん久江", "まえくら ひさえ", "ﾏｴｸﾗﾋｻｴ", "MAEKURA, Hisae", "Hisae Maekua", "前食久江", "前倉ひさえ"]
    assert core_of("Takahama Ayaichi")[0] == core_of("takahamaayaichi")[0]
    tetsuya = ["黒口徹也", "黒徹也", "黒口てつや", "Tetsuya Kuroguchi", "Kuroguchi T.", "黒口主任", "テツさん", "黑口徹也", "クログテ テツヤ", "kuroguchi​tetuya"]
    yuusuke = ["岩木悠介", "岩本悠介"]
    rows = [("A", n, "x", "y") for n in hisae[:3] + hisae[4:] + tetsuya + yuusuke] + [("A", "前倉久人", "x", "y"), ("A", "ヒサさん", "x", "y"), ("A", "前倉さん", "x", "y"), ("B", "テツさん", "x", "y"), ("A", "黒口徹也", "x", "y")]
    rows += [("A", None, "x", "y"), (None, "前倉久江", "x", "y"), ("A", "", "x", "y"), ("A", "　", "x", "y"), ("A", "長" * 5_000, "x", "y")]
    got = people(spark, rows)
    assert {got[("A", n)] for n in hisae[:3] + hisae[4:]} == {"前倉久江"}
    assert len({got[("A", n)] for n in tetsuya}) == 1 and len({got[("A", n)] for n in yuusuke}) == 1
    assert got[("A", "前倉久人")] != got[("A", "前倉久江")]
    assert got[("A", "ヒサさん")].startswith("=") and got[("A", "前倉さん")].startswith("=")  # two persons are alike near
    assert got[("B", "テツさん")].startswith("=") and ("A", "") not in got and ("A", "　") not in got and all(p for p, _ in got)
    assert link_spellings(spark.createDataFrame([], "store STRING, staff STRING"), "store", "staff", LEXICON).count() == 0


def test_persons_without_kanji_and_pairs(spark):
    df = spark.createDataFrame([("A", "ナガハシ アサヨ"), ("A", "Nagahashi Asayo"), ("A", "Nagahasi Asayo"), ("A", "Asayo NAGAHASHI")], "store STRING, staff STRING")
    linked = link_spellings(df, "store", "staff", LEXICON)
    pairs = {(r.name_a, r.name_b) for r in spelling_pairs(linked).collect()}
    assert len(pairs) == 6 and all(a < b for a, b in pairs)


def test_places(spark):
    stores = spark.createDataFrame([(1, "前倉ガーデン西口店"), (2, "黒口プラザ3号店"), (3, "長橋ロードA館店"), (4, "長橋パークA館店")], "store_id INT, store_name STRING")
    want = {
        "前倉ガーデン西口店": 1, "前倉ガーデン西口": 1, "前倉ｶﾞｰﾃﾞﾝ西口店": 1, "ガーデン前倉西口店": 1, "(前倉)ガーデン西口店": 1, "マエクラガーデン西口店": 1, "前倉ガデン西口店": 1, "前倉GDN西口店": 1,
        "黒ロプラザ３号店": 2, "黒口プラ3号店": 2, "黒口ブラザ3号店": 2, "長矯ロードA館店": 3, "長橋A館店": None, "遠い店": None, "": None, "店" * 3_000: None,
    }
    df = spark.createDataFrame([(w, "x") for w in want] * 2 + [(None, "x")], "written STRING, place STRING")
    got = {r.written: r.place for r in resolve_places(df, "written", stores, "store_name", LEXICON).collect()}
    names = {r.store_id: r.store_name for r in stores.collect()}
    assert got == {w: names[i] for w, i in want.items() if i}
    assert resolve_places(df.limit(0), "written", stores, "store_name", LEXICON).count() == 0
    assert resolve_places(df, "written", stores.limit(0), "store_name", LEXICON).count() == 0


def test_lexicon_skips_blank_rows():
    lexicon = Lexicon.of([*LEXICON, dict(zip(FIELDS, ("given", None, None, None, None), strict=True))])
    assert len(lexicon.given) == 5 and "ヒサ" in lexicon.kana_words()


def test_names_that_no_lexicon_knows(spark):
    """Names join names: by segments of their own, in any script, in either order of parts."""
    english = ["Jonathan Smithson", "Jonathon Smithson", "Smithson Jonathan", "JONATHAN  SMITHSON"]
    korean, russian, accents = ["김민수", "김민주"], ["Иван Петров", "Петров Иван", "Иван Петроф"], ["Müller Jürgen", "Muller Jurgen"]
    apart = ["Anna", "Anne", "Łukasz", "山"]
    df = spark.createDataFrame([("A", n) for n in english + korean + russian + accents + apart] + [("B", english[1])], "store STRING, staff STRING")
    for lexicon in (LEXICON, []):
        rows = link_spellings(df, "store", "staff", lexicon).collect()
        got = {(r.place, r.written): r.person for r in rows}
        assert len(rows) == len(got) == df.count()
        for group in (english, korean, russian, accents):
            assert len({got[("A", n)] for n in group}) == 1, group
        assert len({got[("A", g)] for g in [english[0], korean[0], russian[0], accents[0], *apart]}) == 4 + len(apart)


def test_one_row_for_spellings_that_fold_to_one_core(spark):
    """前食久江 reads like the registered 前倉久江 and must not be linked a second time."""
    df = spark.createDataFrame([("A", n) for n in ("前倉久江", "前食久江", "久江 前倉", "岩木悠介", "岩本悠介", "イワモト ユウスケ", "イワキ ユウスケ")], "store STRING, staff STRING")
    linked = link_spellings(df, "store", "staff", LEXICON)
    rows = linked.collect()
    assert len(rows) == 7 and len({r.written for r in rows}) == 7
    assert len({r.person for r in rows if r.written[0] in "岩イ"}) == 1
    pairs = spelling_pairs(linked).collect()
    assert len(pairs) == len(set(pairs)) == 3 + 6
    classes = {r.written: (r.class_id, r.links) for r in spelling_classes(linked).collect()}
    assert classes["前食久江"] == ("久江 前倉", 2) and classes["岩本悠介"] == ("イワキ ユウスケ", 3)


def test_chains_end_at_their_least_core(spark):
    edges = [("A", f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("A", "x", "y"), ("B", "n001", "z"), ("B", "z", "n001")]
    rnd = random.Random(3)
    rnd.shuffle(edges)
    got = {(r.place, r.core): r.root for r in components(spark.createDataFrame(edges, "place STRING, core STRING, to STRING")).collect()}
    assert got == {**{("A", f"n{i:03}"): "n000" for i in range(41)}, ("A", "x"): "x", ("A", "y"): "x", ("B", "n001"): "n001", ("B", "z"): "n001"}
    assert components(spark.createDataFrame([], "place STRING, core STRING, to STRING")).count() == 0


def test_short_texts_keep_the_pigeonhole():
    for k in (1, 2):
        for a in ("a", "ab", "abc"):
            for b in ("a", "b", "ab", "ba", "abc", "abd", "xbc"):
                allowed = min(k, len(a) - 1)
                if plain_distance(a, b) <= allowed:
                    assert set(index_keys(a, k)) & {key for n in range(k + 1) for key in probe_keys(b, n)}, (a, b, k)


def test_surnames_of_any_length(spark):
    lexicon = [*LEXICON, dict(zip(FIELDS, ("surname", "林", "ハヤシ", "Hayashi", None), strict=True)), dict(zip(FIELDS, ("surname", "長谷川", "ハセガワ", "Hasegawa", None), strict=True))]
    stores = spark.createDataFrame([("林タウン本店",), ("長谷川プラザ2号店",), ("前倉プラザ2号店",)], "store_name STRING")
    want = {"タウン林本店": "林タウン本店", "ハヤシタウン本店": "林タウン本店", "プラザ長谷川2号店": "長谷川プラザ2号店", "長谷川PLZ2号店": "長谷川プラザ2号店"}
    df = spark.createDataFrame([(w,) for w in want], "w STRING")
    assert {r.written: r.place for r in resolve_places(df, "w", stores, "store_name", lexicon).collect()} == want
