"""Parsing of typed person names: parts, renderings, and the keys of the segment index."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from collections.abc import Container
from functools import lru_cache
from typing import NamedTuple

from tallyloom.llm.unify import BUILT_IN, make_unifier

# Words that stand beside a name and don't belong to it.
ROLES = (
    "店長 副店長 店長代理 主任 副主任 係長 課長 部長 担当 担当者 応援 代理 早番 中番 遅番 日勤 夜勤 夜番 責任者 リーダー チーフ "
    "マネージャー スタッフ 新人 研修 研修中 ヘルプ 派遣 社員 パート バイト 記入者 報告者 氏名 名前 補佐 兼務 休日 交代"
).split()
HONORIFICS = "さん 様 さま くん 君 ちゃん 氏 殿 先生 先輩".split()
LATIN_TITLES = "mr mrs ms miss dr san kun chan sama".split()
# Old or variant kanji and the ordinary ones.
VARIANTS = dict(zip(
    "眞櫻濱濵澤嶋嶌惠龍德髙﨑齋齊斎邊邉國廣實榮樂淺圓黑靑寶徹彌藏關豐瀨德條曉禮祐瀧晉靜隆祿冨峯峰岳嶽舘館鐵",
    "真桜浜浜沢島島恵竜徳高崎斉斉斉辺辺国広実栄楽浅円黒青宝徹弥蔵関豊瀬徳条暁礼祐滝晋静隆禄富峰峰岳岳館館鉄", strict=True))

# Kanji that are taken for each other in writing or reading; the first one stands for all.
LOOKALIKES = (
    "代伐 樹植 太大犬 司可 林森 浦補 沢択 谷各 崎埼 木本 瀬頼 島鳥 村材 坂板 川河 池地 郎朗 根恨 田由 原源 倉食 橋矯 純鈍 典曲 正止 友反 "
    "前煎 優憂 幸辛 義儀 隆降 信伸 光先 徹撤 健建 直値 白自 康庸 千干 浩活 北比 晴睛 亮享 下不 石右 上土 人入 未末 水氷 鈴鈐 秀季 奈柰 葉菓"
).split()
_FOLD = {ord(c): g[0] for g in LOOKALIKES for c in g[1:]}

# Romaji of the morae, and other spellings of the same syllables.
_MORAE = {
    **dict(zip("アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲンガギグゲゴザジズゼゾダヂヅデドバビブベボパピプペポヴー",
        "a i u e o ka ki ku ke ko sa shi su se so ta chi tsu te to na ni nu ne no ha hi fu he ho ma mi mu me mo ya yu yo ra ri ru re ro wa o n ga gi gu ge go za ji zu ze zo da ji zu de do ba bi bu be bo pa pi pu pe po vu".split() + [""], strict=True)),
}
_SMALL = {"ャ": "ya", "ュ": "yu", "ョ": "yo", "ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o"}
_SPELLINGS = [("sya", "sha"), ("syu", "shu"), ("syo", "sho"), ("tya", "cha"), ("tyu", "chu"), ("tyo", "cho"), ("zya", "ja"), ("zyu", "ju"), ("zyo", "jo"), ("jya", "ja"), ("jyu", "ju"), ("jyo", "jo"), ("cya", "cha"), ("cyu", "chu"), ("cyo", "cho"), ("dzu", "zu"), ("dz", "z"), ("l", "r")]

_KANJI = re.compile(r"[一-鿿々]")
_KANA = re.compile(r"[ァ-ヺー]")


#: Letters from which on a name without a lexicon entry allows one edit, and two, by the way it is written.
OWN_EDITS = {"j": (4, 12), "a": (5, 12), "l": (6, 12), "o": (5, 12)}


def to_katakana(text: str) -> str:
    """Hiragana as katakana."""
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in text)


@lru_cache(100_000)
def romaji(kana: str) -> str:
    """Katakana in Latin letters."""
    out: list[str] = []
    geminate = False
    for c in kana:
        if c == "ッ":
            geminate = True
            continue
        if c in _SMALL and out:
            last, small = out.pop(), _SMALL[c]
            if last.endswith("i") and c in "ャュョ":
                last = last[:-1] + (small[1:] if last in ("shi", "chi", "ji") else small)
            elif last and last[-1] in "aiueo":
                last = last[:-1] + small
            out.append(last)
            continue
        new = _MORAE.get(c, "")
        if geminate and new:
            new = new[0] + new
        geminate = False
        out.append(new)
    return "".join(out)


def squeeze(text: str) -> str:
    """Doubled letters joined."""
    return re.sub(r"(.)\1+", r"\1", text)


# Latin letters that don't decompose, in plain ones.
_STROKES = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ŋ": "n", "ŧ": "t"})


def bare_letters(text: str) -> str:
    """Lower case, without accents and anything but letters."""
    parts = unicodedata.normalize("NFD", text.casefold()).translate(_STROKES)
    return unicodedata.normalize("NFC", "".join(c for c in parts if c.isalpha()))


@lru_cache(200_000)
def skeleton(latin: str) -> str:
    """Latin letters of a name in one spelling: lower case, one romanisation, no doubled letters."""
    s = re.sub("[^a-z]", "", bare_letters(latin))
    for a, b in _SPELLINGS:
        s = s.replace(a, b)
    s = re.sub(r"(?<![sc])hu", "fu", s)
    s = re.sub(r"si", "shi", s)
    s = re.sub(r"ti", "chi", s)
    s = re.sub(r"tu", "tsu", s)
    s = re.sub(r"zi|di", "ji", s)
    return squeeze(s)


@dataclass(frozen=True)
class Lexicon:
    """Name elements: kanji to (kana, romaji), and call names."""

    surnames: dict[str, tuple[str, str]]
    given: dict[str, tuple[str, str, str]]

    @staticmethod
    def of(rows) -> Lexicon:
        """From rows with name_kind, kanji, kana, romaji, called_as; rows without kanji are passed over."""
        surnames, given = {}, {}
        for r in rows:
            if r["kanji"] and r["kana"]:
                latin = r["romaji"] or romaji(r["kana"])
                if r["name_kind"] == "surname":
                    surnames.setdefault(r["kanji"], (r["kana"], latin))
                else:
                    given.setdefault(r["kanji"], (r["kana"], latin, r["called_as"] or ""))
        return Lexicon(surnames, given)

    def kana_words(self) -> list[str]:
        """Readings and call names."""
        return [v[0] for v in self.surnames.values()] + [w for v in self.given.values() for w in (v[0], v[2]) if w]


def fold(text: str) -> str:
    """A text with one kanji for each group that is taken for each other."""
    return text.translate(_FOLD)


def split_kanji(core: str, lexicon: Lexicon) -> tuple[str, str] | None:
    """Surname and given name of a name written in kanji with registered elements, in this order or turned round."""
    for i in range(1, len(core)):
        a, b = core[:i], core[i:]
        if a in lexicon.surnames and b in lexicon.given:
            return a, b
        if a in lexicon.given and b in lexicon.surnames:
            return b, a
    return None


_ROLE = "|".join(sorted(map(re.escape, ROLES), key=len, reverse=True))
_HONOR = "|".join(sorted(map(re.escape, HONORIFICS), key=len, reverse=True))
#: An honorific at the end of a name, or a role behind two letters or more.
_TAIL = f"(?:{_HONOR}|(?<=..)(?:{_ROLE}))$"
_ASIAN = re.compile("[ぁ-ヺ一-鿿]")
_BRACKET = re.compile(r"[(\[<【（]([^)\]>】）]*)[)\]>】）]")


class Core(NamedTuple):
    """A name without what surrounds it, a second reading of it, and its parts turned round."""

    core: str
    alt: str
    turned: str


def core_of(text: str) -> Core:
    """A canonical name without roles, honorifics and separators, a second reading, and the same with its last part first.

    Old kanji become the ordinary ones, hiragana katakana; a call name keeps no honorific
    either, so ``カズくん`` becomes ``カズ``.  Latin names become their skeleton, parts in the
    order given; their second reading has doubled letters joined but keeps the spelling,
    as a slip may have made another syllable of it.  Names in other scripts are their bare letters.
    Else both are the same.
    """
    text = _BRACKET.sub(lambda m: " " if re.fullmatch(rf"(?:{_ROLE})+", m[1].strip()) else " " + m[1], text)
    text = re.sub(rf"^\s*(?:{_ROLE})\s*[::]\s*", "", text)
    parts = [p for p in re.split(r"[\s・/,.:;\-_'\"|]+", text) if p]
    kept = [p for p in parts if not re.fullmatch(rf"(?:{_ROLE})|(?:{_HONOR})", p)] if len(parts) > 1 else parts
    parts = kept or parts
    if not _ASIAN.search("".join(parts)):
        latin = re.search("[a-z]", bare_letters("".join(parts))) is not None
        if latin:
            parts = [p for p in parts if p.lower() not in LATIN_TITLES] or parts
        plain = [p for p in (re.sub("[^a-z]", "", bare_letters(p)) if latin else bare_letters(p) for p in parts) if p]
        read = [skeleton(p) for p in plain] if latin else plain
        shut = squeeze if latin else str
        return Core(shut("".join(read)), shut("".join(plain)), shut("".join(read[-1:] + read[:-1])))
    parts = ["".join(VARIANTS.get(c, c) for c in p) for p in parts]
    bare = [re.sub(_TAIL, "", p) or p for p in parts[-1:]] if len("".join(parts)) > len(parts[-1]) else []
    whole = to_katakana(re.sub(_TAIL, "", "".join(parts)) or "".join(parts))
    return Core(whole, whole, to_katakana("".join(bare + parts[:-1])) if bare else whole)


def kind_of(core: str) -> str:
    """How a core is written: ``l`` Latin, ``a`` kana, ``j`` with kanji, ``o`` in other letters, the empty text without any."""
    if _KANJI.search(core):
        return "j"
    if _KANA.search(core):
        return "a"
    if re.search("[a-z]", core):
        return "l"
    return "o" if any(map(str.isalpha, core)) else ""


def letters_of(core: str, kind: str) -> str:
    """A core letter by letter: syllables of Hangul in their single letters, as a slip of the hand is in one of these."""
    return unicodedata.normalize("NFD", core) if kind == "o" else core


def own_edits(kind: str, length: int) -> int:
    """Edits within which two names that no lexicon knows are one: none for short ones, as there a letter makes another name."""
    first, second = OWN_EDITS[kind]
    return (length >= first) + (length >= second)


def renderings(surname: str, given: str, lexicon: Lexicon) -> list[tuple[str, str, int]]:
    """Folded cores under which a person may be written: (kind, text, edits allowed).

    Parts of a name (a surname, a call name, an initial) allow no edit.
    """
    ks, rs = lexicon.surnames[surname]
    kg, rg, called = lexicon.given[given]
    surname, given = fold(surname), fold(given)
    rs, rg, r_called = skeleton(rs), skeleton(rg), skeleton(romaji(called)) if called else ""
    out = [
        ("j", surname + given, 1), ("j", given + surname, 1), ("j", surname + kg, 1), ("j", kg + surname, 1), ("j", ks + given, 1),
        ("j", surname + given[0], 0), ("j", surname, 0),
        ("a", ks + kg, 1), ("a", kg + ks, 1), ("a", ks, 0), ("a", kg, 0),
        ("l", squeeze(rs + rg), 2), ("l", squeeze(rg + rs), 2), ("l", rs, 0), ("l", squeeze(rs + rg[0]), 0), ("l", squeeze(rg[0] + rs), 0), ("l", rg, 0),
    ]
    if called:
        out += [("j", surname + called, 0), ("a", called, 0), ("a", ks + called, 0), ("l", r_called, 0)]
    return list(dict.fromkeys(out))


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the k + 1 segments of a text of ``length``, which must be more than ``k``; longer segments last."""
    n, extra = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = n + (i >= k + 1 - extra)
        out.append((at, size))
        at += size
    return out


@lru_cache(10_000)
def _cuts(length: int, k: int) -> list[tuple[str, int, int]]:
    """The keys of an indexed text of this length: what begins the key, start and end of the segment."""
    k = min(k, max(length - 1, 0))
    return [(f"{length}|{k}|{i}|", a, a + n) for i, (a, n) in enumerate(segments(length, k))]


@lru_cache(10_000)
def _places(size: int, k: int) -> list[tuple[str, int, int]]:
    """The keys looked up for a text of this size: what begins the key, start and end of its part."""
    out = []
    for length in range(max(1, size - k), size + k + 1):
        shift, cut = size - length, min(k, length - 1)  # short texts are indexed in fewer segments, for fewer edits
        if abs(shift) > cut:
            continue
        for i, (a, n) in enumerate(segments(length, cut)):
            first = max(0, a - i, a + shift - (cut - i))
            last = min(size - n, a + i, a + shift + (cut - i))
            out += [(f"{length}|{cut}|{i}|", start, start + n) for start in range(first, last + 1)]
    return out


def index_keys(text: str, k: int) -> list[str]:
    """Keys of an indexed text: its length and each of its k + 1 segments.  A text isn't cut into more segments than it has letters."""
    return [head + text[a:b] for head, a, b in _cuts(len(text), k)]


def probe_keys(text: str, k: int) -> list[str]:
    """Keys under which texts within ``k`` edits may stand, for each length in reach.

    The i-th segment of a match, with at most i edits before it and at most k - i behind
    it, starts within i places of its own place and within k - i of it from the end.
    """
    return list(dict.fromkeys([head + text[a:b] for head, a, b in _places(len(text), k)]))


@lru_cache(8)
def name_unifier(surnames: tuple[str, ...], words: tuple[str, ...], table: tuple[str, str] = BUILT_IN, more: Container[str] = ()):
    """The canonical form of names, cached in a process."""
    return make_unifier(surnames, words, table, more)
