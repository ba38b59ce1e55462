"""One consistent form for text that looks the same but consists of other characters.

A quick check inside the JVM isolates the values that hold an unstable character:
one whose normalisation quick-check property isn't "yes", an invisible one, a
letter that looks like one of another script, or a look-alike kana or kanji
beside the other script.  Only these values go to Python; there only their
unstable segments, each with the starter before it as boundary context, are
normalised and spliced into the unchanged rest.  Look-alike letters come from the
published confusables data, which the JVM's Unicode library holds, restricted by
script: a letter is settled only if its whole word can be of one script.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import tempfile
import unicodedata
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, for use without a Spark session; with one see published_table.
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινκρυχ", "ABEZHIKMNOPTYXoivkpux", strict=True))
_CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈԚԜаеорсухѕіјһԁԛԝ", "ABEKMHOPCTYXSIJQWaeopcyxsijhdqw", strict=True))
_OTHER_LATIN = {"ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l"}
LATIN = {**_GREEK, **_CYRILLIC, **_OTHER_LATIN}
#: The same as two texts, letter by letter.
BUILT_IN = ("".join(LATIN), "".join(LATIN.values()))
# Marks that look like an ASCII one.
MARKS = {
    "˜": "~", "∼": "~", "〜": "~", "～": "~", "⁓": "~", "∽": "~",
    "‘": "'", "’": "'", "‛": "'", "′": "'", "＇": "'", "“": '"', "”": '"', "‟": '"', "″": '"',
    "゛": "\u3099", "゜": "\u309a", "⁄": "/", "∕": "/", "․": ".", "‚": ",", "﹐": ",", "∶": ":", "ː": ":", "‥": "..", "…": "...", "･": "・", "·": "・", "•": "・", "∙": "・", "⋅": "・",
}
_DASHES = "‐‑‒–—−―─━-"
_DASH = re.compile("[‐‑‒–—−―─━]")
# Kanji or hiragana, and the katakana that look the same.
TWINS = dict(zip("夕口卜八一工力二へべぺ", "タロトハーエカニヘベペ", strict=True))
_KANJI_OF = {k: h for h, k in TWINS.items() if h not in "へべぺ"}
_HIRA_OF = {"ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}

_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f-\x9f]")
_BLANKS = re.compile(r"[   -     　\t\n\r\x0b\x0c]")
_KATA = "ァ-ヺーヽヾ"
_KANJI = "一-鿿㐀-䶿々〆"

#: Letters of scripts that are written without Latin look-alikes in one word.
_CJK = r"\u1100-\u11ff\u2e80-\u2fff\u3005\u3007\u3021-\u3029\u3041-\u30ff\u3130-\u318f\u31f0-\u31ff\u3400-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff\uff66-\uffdc\U00020000-\U0003ffff"
#: Java class of the characters that are stable whatever stands beside them; all others are looked at.
_STABLE = (
    r"\x{20}-\x{7e}\x{a1}-\x{a7}\x{a9}\x{ab}\x{ac}\x{ae}\x{b0}\x{b1}\x{b6}\x{bb}\x{bf}-\x{130}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}"
    r"\x{3001}-\x{3003}\x{3005}\x{3007}-\x{3011}\x{3014}-\x{301b}\x{3041}-\x{3096}\x{309d}\x{309e}\x{30a1}-\x{30fe}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}"
)
_UNSTABLE = f"[^{_STABLE}]"
_TWIN_NEAR = (
    f"[夕口卜八一工力二へべぺ][{_KATA}]|[{_KATA}][夕口卜八一工力二へべぺ]"
    f"|[タロトハーエカニヘベペ][{_KANJI}ぁ-ゖ]|[{_KANJI}ぁ-ゖ][タロトハーエカニヘベペ]"
    f"|[{_KANJI}][夕口卜八工力二]+(?![{_KANJI}])|[夕口卜八一工力二][ぁ-ゖ夕口卜八一工力二]|^[夕口卜八一工力二]|[{_KATA}]-|-[{_KATA}]"
)
QUICK_CHECK = rf"^[ ]|[ ]\z|{_UNSTABLE}|{_TWIN_NEAR}"


class WordFile:
    """A set of words as a sorted file that Spark sends to every worker, of which only the pages asked for are in memory."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __contains__(self, word: str) -> bool:
        return _listed(SparkFiles.get(self.name), word)

    def __iter__(self) -> Iterator[str]:
        with open(SparkFiles.get(self.name), encoding="utf-8") as f:
            yield from (line.rstrip("\n") for line in f)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, WordFile) and self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)


@lru_cache(8)
def _mapped(path: str) -> mmap.mmap | bytes:
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(path) else b""


@lru_cache(100_000)
def _listed(path: str, word: str) -> bool:
    """Whether a line of a file, whose lines are sorted by their bytes, is ``word``."""
    data, asked = _mapped(path), word.encode("utf-8", "surrogatepass")
    low, high = 0, len(data)
    while low < high:
        at = data.rfind(b"\n", low, (low + high) // 2) + 1 or low
        end = data.find(b"\n", at)
        line = data[at:end]
        if line == asked:
            return True
        low, high = (end + 1, high) if line < asked else (low, at)
    return False


class _Either:
    """What is in one of two sets."""

    def __init__(self, a: Container[str], b: Container[str]) -> None:
        self.a, self.b = a, b

    def __contains__(self, word: str) -> bool:
        return word in self.a or word in self.b


def _script(ch: str) -> str:
    """k katakana, h hiragana, c kanji, else the empty text."""
    if not ch:
        return ""
    if "ァ" <= ch <= "ヺ" or ch in "ーヽヾ":
        return "k"
    if "ぁ" <= ch <= "ゖ":
        return "h"
    if "一" <= ch <= "鿿" or "㐀" <= ch <= "䶿" or ch in "々〆":
        return "c"
    return ""


def _settle_twins(text: str, surnames: frozenset[str], kana_words: Container[str]) -> str:
    """Gives each look-alike kana or kanji the script of the word it stands in.

    The nearest letters on both sides that have no twin decide.  If they disagree, a
    registered surname that ends at the character, or just before it, decides; then
    ``ー`` follows katakana only, and the word begun on the left goes on.
    """
    chars = list(text)
    n = len(chars)
    sizes = {len(x) for x in surnames} - {1}
    sure = ["" if c in TWINS or c in _KANJI_OF or c in _HIRA_OF or c in _DASHES else _script(c) for c in chars]
    out = chars[:]
    fixed = {j for size in sizes for i in range(n - size + 1) if text[i : i + size] in surnames for j in range(i, i + size)}
    for i, c in enumerate(chars):
        if i in fixed:
            continue
        kata = TWINS.get(c) or (c if c in _KANJI_OF or c in _HIRA_OF else None)
        dash = c in _DASHES
        if kata is None and not dash:
            continue
        left = right = ""
        j = i - 1
        while j >= 0 and (_script(chars[j]) or chars[j] in _DASHES):
            left = sure[j] or (left or "")
            if sure[j]:
                break
            j -= 1
        j = i + 1
        while j < n and (_script(chars[j]) or chars[j] in _DASHES):
            if sure[j]:
                right = sure[j]
                break
            j += 1
        before = out[i - 1] if i else ""
        after = chars[i + 1] if i + 1 < n else ""
        if dash:
            if before and _script(before) == "k" and (right == "k" or c != "-" and left == "k"):
                out[i] = "ー"
            continue
        if kata in "ヘベペ":
            other = _HIRA_OF[kata]
            sides = {s for s in (left, right) if s in "kh" and s}
            if len(sides) == 1:
                out[i] = kata if sides == {"k"} else other
            elif len(sides) == 2:
                out[i] = kata if _script(before) == "k" else other
            continue
        kanji = _KANJI_OF[kata]
        start, end = i, i + 1
        while start > 0 and _script(chars[start - 1]):
            start -= 1
        while end < n and _script(chars[end]):
            end += 1
        sides = {s for s in (left, right) if s in "kc" and s}
        if kata == "ー":
            if _script(before) == "k":
                start = i
                while start and _script(out[start - 1]) == "k":
                    start -= 1
                if after == "店" and c == "一":  # the rest of 第一店, unless the word is known with its long vowel
                    out[i] = "ー" if "".join(out[start:i]) + "ー" in kana_words else c
                elif left == "k" or right == "k" or before != chars[i - 1]:
                    out[i] = "ー"
            elif _script(before) == "c" and _script(after) == "c":
                out[i] = "一"
            continue
        named = "".join(TWINS.get(x, x) if _script(x) != "c" else x for x in chars[start:end])
        plain = "".join(_KANJI_OF.get(x, x) for x in chars[start:end])
        if named in surnames or plain in surnames:
            out[i] = kanji
        elif "".join(out[max(0, i - 2) : i]) in surnames and "".join(TWINS.get(x, x) for x in chars[i:end]) in kana_words:
            out[i] = kata
        elif sides == {"k"} or after == "ー" or before == "ー" and c == kata:
            out[i] = kata
        elif sides == {"c"}:
            if left and right and before != "ー" or c == kanji:
                out[i] = kanji
        elif len(sides) == 2 and c == kanji:
            if left == "k":
                out[i] = kanji if kanji + after in surnames or after == "店" and c != "卜" else kata
            elif after == "一" and right == "k" or "".join(out[max(0, i - 2) : i]) in surnames:
                out[i] = kata
        else:
            word = "".join(TWINS.get(x, x) for x in chars[start:end] if _script(x) != "h")
            if word in kana_words or any(_script(x) == "k" for x in (before, after)):
                out[i] = kata
    return "".join(out)


@lru_cache(8)
def _tools(table: tuple[str, str]):
    """For one table: the letters' map, and the kinds of characters as they are met."""
    looks = dict(zip(*table, strict=True))

    class Kinds(dict):
        """Character to whether it is unstable: 0 no, 1 yes, 2 yes and it may join the one before it."""

        def __missing__(self, c: str) -> int:
            if unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or c in "゛゜":
                kind = 2
            else:
                kind = int(c in MARKS or not unicodedata.is_normalized("NFKC", c) or bool(_IGNORABLE.match(c)) or bool(_BLANKS.match(c)) or c in looks and "\u2e80" <= c <= "\u2fdf")
            self[c] = kind
            return kind

    return looks, Kinds()


def _segments(text: str, kinds: dict) -> list[tuple[int, int]]:
    """The unstable segments of a text: runs of unstable characters, with the character before a run that may join it."""
    out, i, n = [], 0, len(text)
    while i < n:
        if not kinds[text[i]]:
            i += 1
            continue
        start = i - (kinds[text[i]] == 2 and i > 0)
        while i < n and kinds[text[i]]:
            i += 1
        out.append((start, i))
    return out


def _segment(seg: str, looks: dict[str, str]) -> str:
    """An unstable segment in its composed compatibility form."""
    seg = _BLANKS.sub(" ", _IGNORABLE.sub("", seg))
    return unicodedata.normalize("NFKC", "".join(looks[c] if c in looks and "\u2e80" <= c <= "\u2fdf" else MARKS.get(c, c) for c in seg))


_WORD = re.compile(rf"[^\W\d_{_CJK}]+")
_TWIN_OR_DASH = re.compile("[" + "".join(TWINS) + "".join(TWINS.values()) + _DASHES + "]")


def _settle_latin(text: str, looks: dict[str, str]) -> str:
    """Letters that look like Latin ones as Latin; a word with a letter that has no Latin twin stays as it is."""

    def word(m: re.Match[str]) -> str:
        return "".join(looks.get(x, x) for x in m[0]) if all(x in looks or x.isascii() for x in m[0]) else m[0]

    return _WORD.sub(word, text)


def make_unifier(surnames: Iterable[str] = (), kana_words: Iterable[str] = (), table: tuple[str, str] = BUILT_IN, more: Container[str] = ()):
    """The function text -> canonical text, for one set of registered surnames and kana words, also those in ``more``, and one table of look-alike letters."""
    names, words = frozenset(surnames), _Either(frozenset(kana_words), more)
    looks, kinds = _tools(table)

    @lru_cache(200_000)
    def unify(text: str) -> str:
        seen = []
        while text not in seen:  # a settled letter may settle its neighbour
            seen.append(text)
            text = once(text)
        return min(seen[seen.index(text) :])  # a form that comes back to itself; should several take turns, their least

    def once(text: str) -> str:
        if text.isascii():
            return _IGNORABLE.sub("", _BLANKS.sub(" ", text)).strip(" ")
        parts, at = [], 0
        for start, end in _segments(text, kinds):
            parts += [text[at:start], _segment(text[start:end], looks)]
            at = end
        text = "".join([*parts, text[at:]])
        if not looks.keys().isdisjoint(text):
            text = _settle_latin(text, looks)
        if _TWIN_OR_DASH.search(text):
            text = _settle_twins(text, names, words)
            text = _DASH.sub("-", text)  # a dash in a katakana word is its long vowel by now
        return text.strip(" ")

    return unify


def published_table(spark: SparkSession) -> tuple[str, str]:
    """Letters that look like an ASCII letter or digit, or like a kanji, and that look: two texts, letter by letter.

    From the confusables data of the Unicode library in the JVM, by the rule: one letter or digit beyond ASCII, in
    its compatibility form already, whose skeleton is that of an ASCII letter, capital for capital; radicals
    whose skeleton is a kanji; small capitals by their names.  About 1,400 letters, computed once a session.
    """
    found = _PUBLISHED.get(spark.sparkContext.applicationId)
    if found is None:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        letters = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xD800), *range(0xF900, 0x20000)]) if unicodedata.category(c)[0] in "LNS" and unicodedata.is_normalized("NFKC", c)]
        skeleton = dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))
        plain: dict[str, str] = {}
        for c in filter(str.isalnum, map(chr, range(0x21, 0x7F))):
            plain[skeleton[c]] = plain.get(skeleton[c], "") + c
        cjk, out = re.compile(f"[{_CJK}]"), dict(LATIN)
        for c, look in skeleton.items():
            if c.isascii() or unicodedata.category(c)[0] not in "LN" and not "\u2e80" <= c <= "\u2fdf":
                continue
            if cjk.match(c):
                if "\u2e80" <= c <= "\u2fdf" and len(look) == 1 and "\u4e00" <= look <= "\u9fff":
                    out[c] = look
                continue
            small = re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c, ""))
            choice = small[1] if small else plain.get(look, "")
            fits = [x for x in choice if x.isdigit() == c.isdigit() and (x.isupper() == c.isupper() or len(choice) == 1)]
            if fits:
                out[c] = fits[0]
        found = _PUBLISHED[spark.sparkContext.applicationId] = ("".join(out), "".join(out.values()))
    return found


_PUBLISHED: dict[str, tuple[str, str]] = {}


def needs_unifying(c: Column) -> Column:
    """The quick check: false means that ``c`` is in the canonical form already; null for null."""
    return F.regexp(c, F.lit(QUICK_CHECK))


def lexicon_words(lexicon: DataFrame) -> tuple[list[str], list[str]]:
    """Surnames and kana words of the name lexicon, a table of fixed size (it doesn't grow with the data)."""
    rows = lexicon.select("name_kind", "kanji", "kana", "called_as").collect()
    return (
        sorted({r.kanji for r in rows if r.name_kind == "surname" and r.kanji}),
        sorted({w for r in rows for w in (r.kana, r.called_as) if w}),
    )


def kana_runs(places: DataFrame, name: str) -> WordFile:
    """All katakana words in registered names.

    They are sorted by Spark and pass the driver a part at a time into a file, so neither it nor a worker holds
    them; equal words are sent once a session.
    """
    context = places.sparkSession.sparkContext
    runs = F.explode(F.regexp_extract_all(F.col(name), F.lit("[ァ-ヺー]{2,}"), 0)).alias("w")
    path, digest = os.path.join(tempfile.mkdtemp(prefix="tallyloom-words-"), "words"), hashlib.sha256()
    with open(path, "wb") as f:
        for row in places.select(runs).distinct().orderBy("w").toLocalIterator():
            line = row.w.encode("utf-8") + b"\n"
            digest.update(line)
            f.write(line)
    file = f"tallyloom-words-{digest.hexdigest()}"
    if (context.applicationId, file) not in _SENT:
        named = os.path.join(os.path.dirname(path), file)
        os.rename(path, named)
        context.addFile(named)
        _SENT.add((context.applicationId, file))
    return WordFile(file)


_SENT: set[tuple[str, str]] = set()


def unify_udf(surnames: list[str], kana_words: list[str], table: tuple[str, str] = BUILT_IN, more: Container[str] = ()):
    """Arrow UDF of the canonical form; null stays null, the empty text stays empty."""

    @F.pandas_udf("string")
    def unified(values: pd.Series) -> pd.Series:
        f = make_unifier(tuple(surnames), tuple(kana_words), table, more)
        return values.map(lambda v: None if v is None else f(v))

    return unified


def find_disguised(
    df: DataFrame, row_id: str, fields: list[str], lexicon: DataFrame, table_name: str, words: Container[str] = (), repeats: bool = False
) -> DataFrame:
    """Every field value that isn't in its canonical form: ``table_name, row_id, field, value, canonical``.

    Null, empty and clean values give no row; a value of blanks only has the empty text as canonical form.
    Rows that are repeated (resends) give one row for each distinct value, or with ``repeats`` one each, without a
    shuffle.  A null ``row_id`` is kept.  ``words``: further katakana words that names are made of.
    No shuffle before the quick check; Python sees only the values that fail it.
    """
    surnames, kana = lexicon_words(lexicon)
    udf = unify_udf(surnames, kana, published_table(df.sparkSession), words)
    named = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    each = df.select(F.col(row_id).alias("row_id"), named.alias("_n")).select("row_id", "_n.field", "_n.value")
    done = each.where(needs_unifying(F.col("value"))).withColumn("canonical", udf("value")).where(F.col("canonical") != F.col("value"))
    return (done if repeats else done.dropDuplicates()).select(F.lit(table_name).alias("table_name"), "row_id", "field", "value", "canonical")
