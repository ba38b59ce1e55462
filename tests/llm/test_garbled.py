"""Garbled text: exact round trips, and clean text left alone."""

import random

import pytest

from tallyloom.llm import garbled as G

JA = [f"電話で{n}さんに確認したところ、{i}が正しいとのことです。在庫は{i}台、予約は{i + 3}台です。" for i in range(40) for n in ("下岡隆一", "長島光樹")]
EN = [f"The café kiosk was closed, so only {i} visitors were counted. I don’t think the naïve reading of “{i}” is right." for i in range(60)]
PT = [f"Atenção: a sessão de {i} não foi lançada. A caligrafia é difícil de ler no campo {i}. Já avisei a loja." for i in range(60)]
LENGTH = G.Describer(*G.build_dictionaries([("ja", t) for t in JA] + [("en", t) for t in EN] + [("pt", t) for t in PT]))

CHAINS = [("utf_8", "latin-1"), ("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("utf_8", "cp437"), ("utf_8", "koi8_r"), ("cp932", "latin-1"), ("euc_jp", "latin-1")]


def spoil(text, real, read):
    data = text.encode(real)
    return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in data)


@pytest.mark.parametrize(("real", "read"), CHAINS)
def test_whole_text_and_one_sentence(real, read):
    clean = "電話で下岡隆一さんに確認したところ、44が正しいとのことです。"
    assert G.restore(spoil(clean, real, read), LENGTH)[0] == clean
    mixed = "在庫は35台、予約は40台です。\n"
    assert G.restore(mixed + spoil(clean, real, read) + "\n" + mixed, LENGTH)[0] == mixed + clean + "\n" + mixed


@pytest.mark.parametrize("text", [EN[7], PT[7]])
@pytest.mark.parametrize("read", ["latin-1", "cp1252", "mac_roman", "cp437", "cp932", "gb18030"])
def test_single_accents(text, read):
    bad = spoil(text, "utf_8", read) if read not in ("cp932", "gb18030") else text.encode().decode(read, "replace")
    fixed, steps, gain = G.restore(bad, LENGTH)
    assert steps and gain > 0
    if "�" not in bad:
        assert fixed == text


def test_twice():
    text = PT[3]
    twice = spoil(spoil(text, "utf_8", "cp1252"), "utf_8", "cp1252")
    assert G.restore(twice, LENGTH)[0] == text


def test_lost_characters_are_still_found():
    bad = JA[5].encode().decode("cp932", "replace")
    fixed, steps, _ = G.restore(bad, LENGTH)
    assert steps and "確認" in fixed


@pytest.mark.parametrize("text", [
    *JA[:5], *EN[:5], *PT[:5], "ﾀﾌﾞﾚｯﾄﾉ ｼﾞｭｳﾃﾞﾝ ｶﾝﾘｮｳ (4ﾀﾞｲ)", "了解しました👍 12件で確定します。☎①②③㈱→※", "É à São Luís, Ñandú — “ok” … €5", "", " ", "plain", "Ünïcödé ßtraße", "кириллица и текст",
])
def test_clean_text_stays(text):
    assert G.restore(text, LENGTH) == (text, [], 0)


def test_operator(spark):
    docs = [(i, t, "ja", "s") for i, t in enumerate(JA)] + [(100 + i, t, "en", "s") for i, t in enumerate(EN)]
    bad = spoil(JA[0], "utf_8", "cp1252")
    docs += [(900, bad, None, "s"), (901, bad, "ja", "s"), (901, bad, "ja", "s"), (902, None, "ja", "s"), (903, "", None, "s"), (904, JA[1] * 300 + bad, "ja", "s"), (None, bad, "ja", "s")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, key STRING")
    rows = G.find_garbled(df, "doc_id", "text", "lang").collect()
    assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x or 0)) == [900, 901, 901, 904, None]
    assert all(r.restored.endswith(JA[0]) for r in rows)
    assert G.find_garbled(df.limit(0), "doc_id", "text", "lang").count() == 0


RU = [f"Позвонили в магазин {n} и проверили отчёт номер {i}: сумма верна, исправлять ничего не нужно." for i in range(40) for n in ("Южный", "Центральный")]
KO = [f"매장 {n}에 전화해서 보고서 {i}번을 확인했습니다. 합계가 맞으니 고칠 것이 없습니다." for i in range(40) for n in ("강남", "신촌")]
WIDE = G.Describer(*G.build_dictionaries([("ja", t) for t in JA] + [("pt", t) for t in PT] + [("ru", t) for t in RU] + [("ko", t) for t in KO]))


@pytest.mark.parametrize("read", ["mac_roman", "cp1251", "latin-1", "cp437", "koi8_r"])
@pytest.mark.parametrize("clean", [RU[7], KO[9]])
def test_other_scripts(clean, read):
    """Scripts of the sample's languages are known letters, whatever they look like."""
    assert G.restore(spoil(clean, "utf_8", read), WIDE)[0] == clean
    assert G.restore(clean, WIDE) == (clean, [], 0)


@pytest.mark.parametrize("rounds", [3, 4, 5, 6])
def test_chains_of_any_length(rounds):
    text = bad = PT[3]
    for _ in range(rounds):
        bad = spoil(bad, "utf_8", "latin-1")
    assert G.restore(bad, LENGTH)[0] == text


def test_garbled_sentences_leave_the_sample():
    """One text in ten is garbled: the dictionaries hold none of it, and it is still found."""
    bad = [spoil(t, "utf_8", "cp1252") for t in PT[::10]] + [spoil(t, "utf_8", "mac_roman") for t in PT[5::10]]
    length = G.Describer(*G.build_dictionaries([("ja", t) for t in JA] + [("pt", t) for t in [*PT, *bad]]))
    assert "Ã" not in length.alphabet and "√" not in length.alphabet
    assert all(G.restore(t, length)[1] for t in bad) and not any(G.restore(t, length)[1] for t in PT)


def test_screening_changes_nothing():
    """The same result with and without leaving readings with unknown letters out, on random texts of one language."""
    rnd = random.Random(11)
    loose = ["浅村ハーバーA館店へ", "車場が満車で", "§±", "�", "☎①", "Ã©", "\x81f"]
    for _ in range(400):
        pool = rnd.choice([JA, PT, RU, KO])
        parts = [rnd.choice(pool)[: rnd.randrange(1, 60)] for _ in range(rnd.randrange(1, 5))]
        parts = [spoil(p, "utf_8", rnd.choice(["cp1252", "mac_roman", "cp437", "koi8_r"])) if rnd.random() < 0.25 else p for p in parts]
        parts += [rnd.choice(loose)] * (pool is JA and rnd.random() < 0.5)
        rnd.shuffle(parts)
        text = rnd.choice(["", " ", "\n"]).join(parts)
        assert G.restore(text, WIDE) == G.restore(text, WIDE, screen=False), text


def test_all_documents_make_the_dictionaries(spark, monkeypatch):
    """As from memory, with halves, garbled sentences and rare letters: late sentences, more documents than any bound, more than 64 languages."""
    monkeypatch.setattr(G, "DICTIONARY", 3_000)
    texts = [("ja", t) for t in JA] + [("pt", t) for t in PT] + [("pt", spoil(t, "utf_8", "cp1252")) for t in PT[::9]] + [(f"x{i}", f"Sentence of language {i}.") for i in range(70)]
    texts += [("en", "no. " * 1_200 + "Late sentence with ž alone.")] * 3 + [("en", "no " * 1_500)] * 4 + [("en", f"Number {i} is here.") for i in range(1_500)] + [("en", "One ŵ only.")]
    df = spark.createDataFrame([(i, t, name) for i, (name, t) in enumerate(texts)], "doc_id BIGINT, text STRING, lang STRING")
    found = G.language_dictionaries(df, "text", "lang")
    assert found == G.build_dictionaries(texts)
    words, letters = found
    assert len(words) == 73 and words["en"].endswith("Late sentence with ž alone.".encode()) and "ž" in letters and "ŵ" not in letters and "Ã" not in letters
    assert G.language_dictionaries(df.where("lang IS NULL"), "text", "lang") == ({}, "")
