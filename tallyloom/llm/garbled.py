"""Text that was decoded with the wrong character encoding: found, and restored.

A step of garbling is (read as W, really T).  Undoing it encodes a stretch with W and
decodes the bytes with T.  Every stretch whose bytes form characters of T under some
pair is a candidate, however short: each unbroken run of them, each run of bytes around
them, and each line.  Candidates are compressed with a zstandard dictionary of each
language, and the shortest description (the least over the languages, plus the cost of
the chain) decides between them and the text as it is.  The search is repeated on its
result until nothing is shorter, which undoes chains of any number of steps.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.tables import materialize, scratch, spread

#: Encodings with one byte a character that text may have been read with.
SINGLE = ["cp1252", "mac_roman", "cp437", "cp850", "koi8_r", "cp1251", "cp866", "cp1250", "iso8859_15", "cp1254", "cp1253", "iso8859_2", "mac_cyrillic", "iso8859_5", "cp775", "cp852", "cp1257"]
#: Encodings with several bytes a character.
MULTI = ["cp932", "gb18030", "euc_jp", "big5hkscs", "cp949"]
#: Real encodings besides UTF-8 that were read as any of the above, and how their characters beyond ASCII look as bytes.
LEGACY = {
    "cp932": r"(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]|[\xa6-\xdf])",
    "euc_jp": r"(?:\x8f[\xa1-\xfe]{2}|[\xa1-\xf4][\xa1-\xfe]|\x8e[\xa1-\xdf])",
}
#: Bytes that each further step of a chain costs, and that naming a stretch costs.
CHAIN_COST = 1
STRETCH_COST = 3
#: Bytes that spelling a character outside the languages' alphabet costs: the first of its block, one that stays in the block, one that stays among Han or Hangul, and a lost one.
BLOCK_COST = 5
NOVEL_COST = 1
WIDE_COST = 2
LOST_COST = 3
#: Bytes that a letter of the alphabet costs at most, however rare: its place among some thousands.
LETTER_COST = 1
#: Bytes that each byte costs that the real encoding can't decode: it would have to be told besides the restored text.
BROKEN_COST = 2
#: A letter of the alphabet stands in one sentence at least of so many documents of some language; rarer ones have to be spelled.
RARE = 600
#: Bytes of a dictionary: what zstandard refers to.
DICTIONARY = 112_640
#: Characters around a stretch that are compressed with it: the gain must show in each, as the size of a short text is uneven.
_CONTEXTS = (16, 40)
_LOST = "�"
_VALID = r"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3})"


#: Unbroken stretches of an encoding's characters beyond ASCII, and such joined over the other bytes of a line.
_UNBROKEN = {real: re.compile(f"{c}+") for real, c in {"utf_8": _VALID, **LEGACY}.items()}
_JOINED = {real: re.compile(f"{c}(?:[\\t\\x20-\\x7e\x80-\xffā]*{c})?") for real, c in {"utf_8": _VALID, **LEGACY}.items()}
_C1 = re.compile("[\x80-\x9f]")
_BYTES = re.compile("[\x80-\xffā]+")
_LINE = re.compile(r"[^\r\n]+")


@dataclass(frozen=True)
class Single:
    """One-byte encoding: characters to bytes, one to one, a pattern that any garbled UTF-8 matches, and one of two bytes beyond ASCII in a row."""

    name: str
    table: dict
    hint: re.Pattern
    pair: re.Pattern


#: The first bytes of a character whose last byte was lost.
_CUT = re.compile("[\xe1-\xef][\x80-\xbf]\u0101|[\xc3-\xdf]\u0101")


class _Table(dict):
    """Characters without a byte become U+0100, lost ones U+0101."""

    def __missing__(self, key: int) -> int:
        self[key] = value = 0x101 if key == 0xFFFD else key if key < 0x80 else 0x100
        return value


@lru_cache(None)
def single(name: str) -> Single:
    """The table of a one-byte encoding; the C1 controls stand for themselves, as readers leave undefined bytes."""
    table = _Table()
    chars = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(name)
        except UnicodeDecodeError:
            ch = chr(b)
        table[ord(ch)] = b
        chars[b] = {ch}
    for b in range(0x80, 0xA0):
        if b not in table:
            table[b] = b
            chars[b].add(chr(b))

    def among(first: int, last: int) -> str:
        return "[" + "".join(sorted(re.escape(c) for b in range(first, last + 1) for c in chars[b])) + "]"

    return Single(name, table, re.compile(among(0xC2, 0xF4) + among(0x80, 0xBF)), re.compile(among(0x80, 0xFF) + "{2}"))


class _Bytes(dict):
    """Characters to the bytes of an encoding with several bytes, as a string of U+0080 to U+00FF, for ``str.translate``."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __missing__(self, key: int) -> str:
        ch = chr(key)
        if key < 0x80:
            value = ch
        elif ch == _LOST:
            value = "\u0101"
        else:
            try:
                value = ch.encode(self.name).decode("latin-1")
            except UnicodeEncodeError:
                value = ch if "\x80" <= ch <= "\x9f" else "\u0100"
        self[key] = value
        return value


@lru_cache(None)
def multi(name: str) -> _Bytes:
    """The byte table of an encoding with several bytes a character."""
    return _Bytes(name)


def _decoded(raw: str, real: str) -> tuple[str, int]:
    """Bytes given as characters in their real encoding, broken and lost ones as one U+FFFD, and the number of broken ones."""
    data = raw.replace("\u0100", "\xff").replace("\u0101", "\xff").encode("latin-1")
    try:
        return data.decode(real), 0
    except UnicodeDecodeError:
        new = data.decode(real, errors="surrogateescape")
        return _BROKEN.sub(_LOST, new), max(0, len(_BROKEN_EACH.findall(new)) - raw.count("\u0101"))


_BROKEN, _BROKEN_EACH = re.compile("[\udc80-\udcff]+"), re.compile("[\udc80-\udcff]")


def completed(text: str, alphabet: frozenset[str]) -> Iterator[tuple[int, int, str, str, int]]:
    """Characters whose last byte was lost: each character of the alphabet that begins with the bytes left."""
    for name in ("cp932", "gb18030"):
        codec = multi(name)
        for at in re.finditer(_LOST, text):
            raw = text[max(0, at.start() - 2) : at.end()].translate(codec)
            m = None
            for m in _CUT.finditer(raw):
                pass
            if m is None or m.end() != len(raw):
                continue
            start = at.start() - 1
            while len(text[start : at.end()].translate(codec)) < len(m[0]):
                start -= 1
            if len(text[start : at.end()].translate(codec)) != len(m[0]):
                continue
            first = m[0][:-1].encode("latin-1")
            for last in range(0x80, 0xC0):
                ch = (first + bytes([last])).decode("utf-8", errors="ignore")
                if ch in alphabet and ch:
                    yield start, at.end(), ch, f"utf_8 read as {name}", 0


def _spans(raw: str, real: str) -> set[tuple[int, int]]:
    """Stretches of bytes that an encoding may explain: unbroken ones, with all bytes around them, and joined over a line."""
    unbroken = {m.span() for m in _UNBROKEN[real].finditer(raw)}
    if not unbroken:
        return unbroken
    around = {m.span() for m in _BYTES.finditer(raw) if _UNBROKEN[real].search(raw, *m.span())} if real == "utf_8" else set()
    return unbroken | around | {m.span() for m in _JOINED[real].finditer(raw)}


@lru_cache(None)
def _neighbours() -> re.Pattern:
    """Two neighbours that are bytes beyond ASCII for some reader with one byte a character."""
    chars = {chr(c) for name in SINGLE for c, b in single(name).table.items() if 0x80 <= b <= 0xFF}
    return re.compile("[" + "".join(sorted(map(re.escape, chars))) + "]{2}")


def candidates(text: str, length: Describer | None = None) -> Iterator[tuple[int, int, str, str, int]]:
    """Stretches (start, end, restored, step, broken bytes) of a text that some pair of encodings would explain, line by line.

    A reader with one byte a character is tried if UTF-8 could be behind two neighbouring characters, and
    for the legacy encodings if two neighbours are bytes beyond ASCII or there is a C1 control; those with several bytes
    always, for UTF-8.
    ``length``: leave out readings with unknown letters for stretches of known ones.
    """
    for line in _LINE.finditer(text):
        if not line[0].isascii():
            at = line.start()
            for a, b, new, step, broken in _line_candidates(line[0], length):
                yield at + a, at + b, new, step, broken


def _line_candidates(text: str, length: Describer | None) -> Iterator[tuple[int, int, str, str, int]]:
    seen = set()
    controls = _C1.search(text) is not None
    if controls or _neighbours().search(text):
        for name in SINGLE:
            codec = single(name)
            reals = ["utf_8"] * (codec.hint.search(text) is not None) + list(LEGACY) * (controls or codec.pair.search(text) is not None)
            raw = text.translate(codec.table) if reals else ""
            for real in reals:
                for a, b in _spans(raw, real):
                    new, broken = _decoded(raw[a:b], real)
                    if (a, b, new) not in seen:  # encodings agree in many characters
                        seen.add((a, b, new))
                        if length is None or length.knows(new) or not length.knows(text[a:b]):
                            yield a, b, new, f"{real} read as {name}", broken
    known = length is not None and length.knows(text)
    for name in MULTI:
        raw = text.translate(multi(name))
        spans = _spans(raw, "utf_8")
        if known:  # the same in bytes, before anything is decoded
            spans = {s for s in spans if length.bytes_known.fullmatch(raw, *s)}
        if not spans:
            continue
        ends = list(accumulate(map(len, map(multi(name).__getitem__, map(ord, text)))))
        for a, b in spans:
            first, last = bisect_right(ends, a), bisect_left(ends, b) + 1  # whole characters only
            new, broken = _decoded(raw[ends[first - 1] if first else 0 : ends[last - 1]], "utf_8")
            if (first, last, new) not in seen:
                seen.add((first, last, new))
                if length is None or length.knows(new) or not length.knows(text[first:last]):
                    yield first, last, new, f"utf_8 read as {name}", broken


def _block(c: int) -> int:
    """Blocks of 128 characters; all Han and all Hangul are one each."""
    return -1 if 0x2E80 <= c < 0xA000 and not 0x3000 <= c < 0x3400 else -2 if 0xAC00 <= c < 0xD7A4 else c >> 7


def _bytes_of(alphabet: frozenset[str]) -> re.Pattern:
    """Texts of an alphabet's characters, as the characters of their UTF-8 bytes."""
    lasts: dict[str, str] = {}
    for c in sorted(alphabet):
        data = c.encode("utf-8", "surrogatepass").decode("latin-1")
        lasts[data[:-1]] = lasts.get(data[:-1], "") + re.escape(data[-1])
    return re.compile("(?:" + "|".join(f"{re.escape(first)}[{last}]" for first, last in sorted(lasts.items())) + ")+")


class Describer:
    """Description length of a text: the least compressed size over the languages' dictionaries.

    The letters of the alphabet are compressed.  Any other has to be spelled: where a block of characters
    begins by its full number, else by its place in the block; what a lost one stood for as well.
    """

    def __init__(self, dictionaries: dict[str, bytes], alphabet: str = "") -> None:
        import zstandard

        def compressor(data: bytes):
            words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=3)
            return zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_dict_id=False)

        self._each = [compressor(d) for d in dictionaries.values() if d] or [zstandard.ZstdCompressor(level=3, write_content_size=False)]
        self.alphabet = frozenset("".join(d.decode("utf-8", "replace") for d in dictionaries.values()) + alphabet) - {_LOST} | frozenset(map(chr, range(0x80)))
        self.bytes_known = _bytes_of(self.alphabet)
        self.least = min(len(c.compress(b"")) for c in self._each)
        self._known: dict[str, int] = {}

    def knows(self, text: str) -> bool:
        """Whether all characters of a text are in the alphabet."""
        return self.alphabet.issuperset(text)

    def spelled(self, text: str) -> tuple[str, float]:
        """The known letters of a text, and what it costs to spell the unknown and lost ones; none is cheaper than a known letter may be."""
        if self.knows(text):
            return text, 0
        known, cost, last = [], 0, None
        for c in text:
            if c in self.alphabet:
                known.append(c)
            elif c == _LOST:
                cost += LOST_COST
            else:
                block = _block(ord(c))
                cost += (NOVEL_COST if block >= 0 else WIDE_COST) if block == last else BLOCK_COST
                last = block
        return "".join(known), cost

    def __call__(self, text: str) -> int:
        size = self._known.get(text)
        if size is None:
            known, cost = self.spelled(text)
            data = known.encode("utf-8", "surrogatepass")
            size = min(min(len(c.compress(data)) for c in self._each), self.least + int(LETTER_COST * len(known))) + int(cost)
            if len(self._known) > 50_000:
                self._known.clear()
            self._known[text] = size
        return size


def _gain(text: str, a: int, b: int, new: str, length: Describer, cost: int) -> int:
    """Bytes by which a text is shorter with ``new`` from ``a`` to ``b`` than by its cost; the least over the contexts, not beyond 0 once one says so."""
    least = 0
    for around in _CONTEXTS:
        left, right = text[max(0, a - around) : a], text[b : b + around]
        before, after = length(left + text[a:b] + right), left + new + right
        gain = before - cost - length.least - int(length.spelled(after)[1])  # it can't be more
        if gain > 0:
            gain = before - cost - length(after)
        if gain <= 0:
            return 0
        least = min(least, gain) if least else gain
    return least


def restore(text: str, length: Describer, screen: bool = True) -> tuple[str, list[str], int]:
    """The restored text, the chain of steps and the bytes gained; the text itself and no steps where nothing is shorter.

    ``screen``: a stretch of known letters only is never held against a reading with unknown ones.  This is a rule besides
    the description length.  On texts of one language it only saves work (the tests hold both ways against each
    other); where languages or loose letters are mixed within a few words, it keeps known letters as they are.
    """
    steps: list[str] = []
    total = n = 0
    while True:
        found = []
        for a, b, new, step, broken in [*candidates(text, length if screen else None), *completed(text, length.alphabet)]:
            gain = _gain(text, a, b, new, length, STRETCH_COST + CHAIN_COST * n + BROKEN_COST * broken) if new != text[a:b] else 0
            if gain > 0:
                found.append((gain, a, b, new, step))
        if not found:
            return text, steps, total
        chosen: list[tuple] = []
        for f in sorted(found, key=lambda f: (-f[0], f[1], f[2], f[4])):
            if all(f[2] <= c[1] or f[1] >= c[2] for c in chosen):
                chosen.append(f)
        for gain, a, b, new, step in sorted(chosen, key=lambda f: -f[1]):
            text = text[:a] + new + text[b:]
            total += gain
            steps += [step] * (step not in steps[-1:])
        n += 1


#: Java class of characters that no script writes: controls, lost ones, private ones, frames.  Documents with one teach nothing.
_ODD = r"[\x{80}-\x{9f}\x{fffd}\x{e000}-\x{f8ff}\x{2500}-\x{259f}]"


#: Where a sentence ends, for Python and Java.
_END = r"(?<=[。.!?！？\n])"


def language_dictionaries(docs: DataFrame, text: str, lang: str) -> tuple[dict[str, bytes], str]:
    """A raw dictionary for each language and the alphabet, from all documents of a language without odd characters.

    The same as :func:`build_dictionaries` of them: every sentence is counted and searched, whole and on the executors.  The
    driver gets what the dictionaries have room for and the letters.
    """
    named = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL").where(~F.regexp("text", F.lit(_ODD)))
    half = F.crc32(F.col("text").cast("binary")) % 2
    halves = [F.count(F.when(half == h, 1)).alias(f"n{h}") for h in (0, 1)]
    sizes = {r["lang"]: (r["n0"], r["n1"]) for r in named.groupBy("lang").agg(*halves).collect()}

    def doubt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(doubtful=[_doubtful(p) for p in batch["part"]])

    with scratch():
        each = named.select("lang", half.alias("half"), F.explode(F.array_distinct(F.split("text", _END))).alias("part")).where(F.length("part") > 3)
        counted = materialize(each.groupBy("lang", "part").agg(*[F.count(F.when(F.col("half") == h, 1)).alias(f"n{h}") for h in (0, 1)]))
        counted = materialize(spread(counted, "part").mapInPandas(doubt, "lang STRING, part STRING, n0 BIGINT, n1 BIGINT, doubtful BOOLEAN"))
        shared = docs.sparkSession.sparkContext.broadcast([_model(counted.where("NOT doubtful"), f"n{h}", {k: n[h] for k, n in sizes.items()}) for h in (0, 1)])

        def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            describers = [Describer(*x) for x in shared.value]
            for batch in batches:
                yield batch[[not _bad(p, n, describers) for p, n in zip(batch["part"], zip(batch["n0"], batch["n1"], strict=True), strict=True)]]

        kept = materialize(spread(counted, "part").mapInPandas(clean, counted.schema).selectExpr("lang", "part", "n0 + n1 AS n"))
        return _model(kept, "n", {k: sum(n) for k, n in sizes.items()})


def _model(counted: DataFrame, n: str, docs: dict[str, int]) -> tuple[dict[str, bytes], str]:
    """Dictionaries and alphabet of sentences with their language and their number ``n`` of documents."""
    counted = counted.select("lang", "part", F.col(n).alias("n")).where("n > 0")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.crc32(F.col("part").cast("binary")), "part")
    # no sentence has less than four bytes: as many first ones as a dictionary may hold, taken in each task already
    first = counted.where(F.octet_length("part") <= DICTIONARY).withColumn("r", F.row_number().over(order)).where(F.col("r") <= DICTIONARY // 4)
    best = first.withColumn("size", F.sum(F.octet_length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("size") <= DICTIONARY)
    sentences: dict[str, dict[str, int]] = {}
    for r in best.select("lang", "part", "n").collect():
        sentences.setdefault(r["lang"], {})[r["part"]] = r["n"]

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for row in zip(batch["lang"], batch["part"], batch["n"], strict=True):
                _count_letters(found, *row)
        yield pd.DataFrame([(*k, v) for k, v in found.items()], columns=["lang", "c", "n"])

    common = counted.mapInPandas(letters, "lang STRING, c STRING, n BIGINT").groupBy("lang", "c").agg(F.sum("n").alias("n"))
    return _dictionaries(sentences), _alphabet({(r["lang"], r["c"]): r["n"] for r in common.collect()}, docs)


def _count_letters(found: Counter[tuple[str, str]], lang: str, part: str, n: int) -> None:
    for c in set(part):
        found[lang, c] += n


def _alphabet(letters: dict[tuple[str, str], int], docs: dict[str, int]) -> str:
    """The letters, but those that are rarer than one in ``RARE`` documents in each language."""
    return "".join(sorted({c for (lang, c), n in letters.items() if n * RARE >= docs[lang]}))


def _packed(counts: dict[str, int]) -> bytes:
    """Sentences as a raw dictionary: those of most documents last, where zstandard refers to them cheapest; ties by a hash.  What is longer than a dictionary is in none."""
    best, size = [], 0
    for part, _ in sorted(counts.items(), key=lambda x: (-x[1], crc32(x[0].encode("utf-8", "surrogatepass")), x[0])):
        data = part.encode("utf-8", "surrogatepass")
        if len(data) > DICTIONARY:
            continue
        if size + len(data) > DICTIONARY:
            break
        best.append(data)
        size += len(data)
    return b"".join(reversed(best))


def _dictionaries(sentences: dict[str, dict[str, int]]) -> dict[str, bytes]:
    return {name: _packed(sentences[name]) for name in sorted(sentences)}


def _explained(part: str) -> bool:
    """Whether UTF-8 under some reader explains a whole run of characters beyond ASCII."""
    for m in _HIGH.finditer(part):
        for name in [*SINGLE, *MULTI]:
            raw = m[0].translate(single(name).table if name in SINGLE else multi(name))
            if _UNBROKEN["utf_8"].fullmatch(raw):
                return True
    return False


_HIGH = re.compile(r"[^\x00-\x7f]+")


def _doubtful(part: str) -> bool:
    return not part.isascii() and _explained(part)


def _bad(part: str, n: tuple[int, int], describers: list[Describer]) -> bool:
    """Whether a sentence of ``n`` documents of each half is garbled for the describer of the other half."""
    return not part.isascii() and any(n[h] > 0 and restore(part, describers[1 - h])[1] for h in (0, 1))


def build_dictionaries(texts: list[tuple[str, str]]) -> tuple[dict[str, bytes], str]:
    """The dictionaries and the alphabet of texts in memory, as (language, text).

    Garbled sentences are taken out: each half of the texts is searched with the dictionaries of the other half,
    of which only the sentences count in which no pair of encodings explains a whole run of characters, and what
    is restored is left out.
    """
    counted: dict[tuple[str, str], list[int]] = {}
    docs: dict[str, list[int]] = {}
    for name, text in texts:
        half = crc32(text.encode("utf-8", "surrogatepass")) % 2
        docs.setdefault(name, [0, 0])[half] += 1
        for part in {p for p in re.split(_END, text) if len(p) > 3}:
            counted.setdefault((name, part), [0, 0])[half] += 1

    def model(rows: dict[tuple[str, str], int], size: dict[str, int]) -> tuple[dict[str, bytes], str]:
        sentences: dict[str, dict[str, int]] = {}
        letters: Counter[tuple[str, str]] = Counter()
        for (name, part), n in rows.items():
            if n:
                sentences.setdefault(name, {})[part] = n
                _count_letters(letters, name, part, n)
        return _dictionaries(sentences), _alphabet(letters, size)

    sure = {k: n for k, n in counted.items() if not _doubtful(k[1])}
    describers = [Describer(*model({k: n[h] for k, n in sure.items()}, {k: n[h] for k, n in docs.items()})) for h in (0, 1)]
    return model({k: sum(n) for k, n in counted.items() if not _bad(k[1], tuple(n), describers)}, {k: sum(n) for k, n in docs.items()})


def find_garbled(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``doc_id, restored, steps ARRAY<STRING>, gain INT``: one row for each document with a garbled stretch.

    Documents without one, and null, empty and blank texts, give no row.  Characters that were lost
    for good stay U+FFFD in ``restored``.  A repeated row is repeated in the result; a null id is kept;
    a null language only keeps the document out of the dictionaries.  Extra columns are ignored.  Shuffled
    are the counts of the sentences, and inputs with fewer splits than there are cores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(language_dictionaries(docs, text, lang))
    kind = docs.schema[doc_id].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length = Describer(*shared.value)
        for batch in batches:
            out = []
            for key, body in zip(batch["key"], batch["text"], strict=True):
                new, steps, gain = restore(body, length)
                if steps:
                    out.append((key, new, steps, gain))
            yield pd.DataFrame(out, columns=["key", "restored", "steps", "gain"])

    source = docs.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("text")).where(F.regexp("text", F.lit(r"[^\x{00}-\x{7f}]")))
    found = spread(source, "key").mapInPandas(search, f"key {kind}, restored STRING, steps ARRAY<STRING>, gain INT")
    return found.select(F.col("key").alias(doc_id), "restored", "steps", "gain")
