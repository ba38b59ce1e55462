"""Registered places behind the ways their names are written."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.names import Lexicon, fold, index_keys, name_unifier, probe_keys
from tallyloom.llm.unify import kana_runs, published_table
from tallyloom.tables import materialize

# Usual short forms of the words for a place.
SHORT = {
    "タウン": "TWN", "プラザ": "PLZ", "ステーション": "ST", "センタービル": "CB", "アウトレット": "OL", "スクエア": "SQ", "デパート": "DP", "ガーデン": "GDN",
    "モール": "M", "グランドビル": "GB", "ターミナル": "TML", "ショッピングセンター": "SC", "パーク": "PK", "ビレッジ": "VLG", "ヒルズ": "HLS", "ロード": "RD",
}


def squash(name: str) -> str:
    """A canonical place name without blanks, brackets, separators and the last 店."""
    return re.sub(r"[\s()\[\]・/\-]", "", name).removesuffix("店")


def head_of(plain: str, surnames: dict) -> str:
    """The longest registered surname with which a squashed name begins, or the empty text."""
    return next((plain[:n] for n in range(max(map(len, surnames), default=0), 0, -1) if plain[:n] in surnames), "")


def word_of(plain: str, head: str) -> str:
    """The run of katakana, or the two kanji, behind the family name."""
    found = re.match("[ァ-ヺー]{2,}|[一-龠]{2}", plain[len(head) :]) if head else None
    return found[0] if found else ""


def written_forms(plain: str, head: str, word: str, surnames: dict) -> list[tuple[str, int]]:
    """Forms (squashed text, cost) under which a registered name may be written, each with its least cost."""
    out = {plain: 0}
    rest = plain[len(head) + len(word) :]
    if head:
        out.setdefault(surnames[head][0] + plain[len(head) :], 1)
        if word:
            out.setdefault(word + head + rest, 1)
            for n in range(len(word) - 1, 0, -1):
                out.setdefault(head + word[:n] + rest, 2 if n > 1 else 3)
            if word in SHORT:
                out.setdefault(head + SHORT[word] + rest, 2)
    out.setdefault(plain.replace("ー", ""), 2)
    out.setdefault(fold(plain), 2)
    return list(out.items())


def _with_words(known: DataFrame) -> DataFrame:
    """``place, plain, head, word`` with the words of all names: the shortest word in use, of three letters or more, that begins a run stands for it."""
    words = known.select("word").where("word <> ''").distinct()
    begins = words.select("word", F.explode(F.when(F.length("word") > 3, F.transform(F.sequence(F.lit(3), F.length("word") - 1), lambda n: F.substring("word", F.lit(1), n))).otherwise(F.array().cast("array<string>"))).alias("start"))
    shorter = begins.join(words.select(F.col("word").alias("start")), "start", "left_semi").groupBy("word").agg(F.min_by("start", F.length("start")).alias("start"))
    return known.join(shorter, "word", "left").select("place", "plain", "head", F.coalesce("start", "word").alias("word"))


def resolve_places(texts: DataFrame, text: str, places: DataFrame, name: str, lexicon_rows: list) -> DataFrame:
    """``written, place``: the registered place that each distinct ``text`` means, where exactly one is nearest.

    Equal texts first, then the canonical form, turned, shortened and read forms, and at last one edit
    (segments of the registered names in an inverted index).  Null, empty and blank texts, texts without a
    place within reach and texts with two nearest ones give no row.  Repeated texts give one row.
    """
    lexicon = Lexicon.of(lexicon_rows)
    args = (tuple(lexicon.surnames), tuple(lexicon.kana_words()), published_table(texts.sparkSession), kana_runs(places, name))
    known = places.select(F.col(name).cast("string").alias("place")).where("place IS NOT NULL").distinct()
    written = texts.select(F.col(text).cast("string").alias("written")).where("written IS NOT NULL").distinct()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = [squash(name_unifier(*args)(p)) for p in batch["place"]]
            heads = [head_of(p, lexicon.surnames) for p in plain]
            yield pd.DataFrame({"place": batch["place"], "plain": plain, "head": heads, "word": [word_of(p, h) for p, h in zip(plain, heads, strict=True)]})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, plain, head, word in zip(*(batch[c] for c in ("place", "plain", "head", "word")), strict=True):
                for form, cost in written_forms(plain, head, word, lexicon.surnames):
                    rows.append((p, form, cost, form))
                    if cost < 2:
                        rows += [(p, form, cost + 2, key) for key in index_keys(form, 1)]
            yield pd.DataFrame(rows, columns=["place", "form", "cost", "key"])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for w in batch["written"]:
                plain = squash(name_unifier(*args)(w))
                if plain:
                    rows += [(w, plain, key) for key in dict.fromkeys([plain, fold(plain), *probe_keys(plain, 1)])]
            yield pd.DataFrame(rows, columns=["written", "plain", "key"])

    same = written.join(known, written["written"] == known["place"], "left")
    exact = same.where("place IS NOT NULL").select("written", "place")
    other = same.where("place IS NULL").select("written")
    # the index is many times its places, which Spark's estimate doesn't know: it must not be broadcast
    parsed = _with_words(materialize(known.mapInPandas(parse, "place STRING, plain STRING, head STRING, word STRING")))
    found = other.mapInPandas(probe, "written STRING, plain STRING, key STRING").join(
        parsed.mapInPandas(index, "place STRING, form STRING, cost INT, key STRING").hint("merge"), "key"
    )
    found = found.where((F.col("key") == F.col("form")) | (F.levenshtein("plain", "form", 1) >= 0)).select("written", "place", "cost")
    nearest = found.groupBy("written").agg(
        F.min(F.struct("cost", "place")).alias("a"), F.max(F.struct((-F.col("cost")).alias("cost"), "place")).alias("b")
    )
    return exact.unionByName(nearest.where("a.place = b.place").select("written", F.col("a.place").alias("place")))
