"""Variant spellings of the names of people, linked place by place.

Every spelling is reduced to a core.  Cores are cut into k + 1 segments and put into an
inverted index; the others look up their position-shifted substrings: at most k edits away at
least one segment is found whole.  Each hit is verified by a banded edit distance.  First
the cores that read as full names of registered elements are indexed, under all their
renderings (orders, readings, Latin letters, surname or call name alone), and a spelling joins
the nearest of these persons, if only one is nearest.  The spellings without any in reach are
then indexed themselves, as written and turned round, in whatever script, and look each
other up; what hangs together is one person, by star links to its least core.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.names import LOOKALIKES, Lexicon, core_of, fold, index_keys, kind_of, letters_of, name_unifier, own_edits, probe_keys, renderings, romaji, skeleton, split_kanji
from tallyloom.llm.unify import published_table
from tallyloom.tables import materialize, release

#: Edits looked for among the renderings of registered names, by the way a core is written.
EDITS = {"j": 1, "a": 1, "l": 2, "o": 2}
_CORE = "place STRING, core STRING, alt STRING, turned STRING, kind STRING, surname STRING, given STRING"


def _cores(names: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``place, written`` with ``core, alt, turned, kind, surname, given`` of each (place, written)."""
    args = (tuple(lexicon.surnames), tuple(lexicon.kana_words()), published_table(names.sparkSession))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unify = name_unifier(*args)
        for batch in batches:
            rows = []
            for place, written in zip(batch["place"], batch["written"], strict=True):
                name = core_of(unify(written))
                kind = kind_of(name.core)
                parts = (split_kanji(name.core, lexicon) if kind == "j" else None) or (None, None)
                rows.append((place, written, *(fold(letters_of(x, kind)) for x in name), kind, *parts))
            yield pd.DataFrame(rows, columns=["place", "written", "core", "alt", "turned", "kind", "surname", "given"])

    return names.mapInPandas(parse, "written STRING, " + _CORE)


def _index(cores: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The inverted index ``place, key`` to ``form, k`` with ``person`` for renderings of a registered name and ``to`` for a core itself."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for place, core, alt, turned, kind, surname, given in zip(*(batch[c] for c in ("place", "core", "alt", "turned", "kind", "surname", "given")), strict=True):
                if surname is not None:
                    person, forms = fold(surname + given), renderings(surname, given, lexicon)
                    forms = [(person, None, *f) for f in forms]
                else:
                    forms = [(None, core, kind, form, own_edits(kind, len(form))) for form in dict.fromkeys((core, turned, alt)) if form]
                for person, to, way, form, k in forms:
                    rows += [(place, person, to, form, min(k, max(len(form) - 1, 0)), f"{way}{key}") for key in index_keys(form, k)]
            yield pd.DataFrame(rows, columns=["place", "person", "to", "form", "k", "key"])

    return cores.mapInPandas(index, "place STRING, person STRING, to STRING, form STRING, k INT, key STRING")


def _probe(cores: DataFrame) -> DataFrame:
    """The lookups ``place, core, alt, key`` of the cores."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for place, core, alt, kind in zip(batch["place"], batch["core"], batch["alt"], batch["kind"], strict=True):
                keys = {key for text in {core, alt} if text for k in range(0, EDITS[kind] + 1) for key in probe_keys(text, k)}
                rows += [(place, core, alt, kind + key) for key in sorted(keys)]
            yield pd.DataFrame(rows, columns=["place", "core", "alt", "key"])

    return cores.mapInPandas(probe, "place STRING, core STRING, alt STRING, key STRING")


def _hits(cores: DataFrame, index: DataFrame) -> DataFrame:
    """Verified hits ``place, core, person, to, d`` of cores in an index."""
    # the index is many times its cores, which Spark's estimate doesn't know: it must not be broadcast
    hits = _probe(cores).join(index.hint("merge"), ["place", "key"])
    far = F.lit(99)

    def distance(c: str):
        d = F.levenshtein(F.col(c), F.col("form"), 2)
        return F.when((d >= 0) & (d <= F.col("k")), d).otherwise(far)

    return hits.select("place", "core", "person", "to", F.least(distance("core"), distance("alt")).alias("d")).where("d < 99")


def _nearest(hits: DataFrame) -> DataFrame:
    """``place, core, person`` of hits among persons: the nearest one, null where two are alike near."""
    best = hits.where("person IS NOT NULL").groupBy("place", "core").agg(F.min(F.struct("d", "person")).alias("a"), F.max(F.struct((-F.col("d")).alias("d"), "person")).alias("b"))
    return best.select("place", "core", F.when(F.col("a.person") == F.col("b.person"), F.col("a.person")).alias("person"))


def _readable(cores: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The columns of a core for those in kana or Latin letters that read as a registered name; the first kanji of the reading stand for it."""
    by_kana: dict[str, tuple[str, str]] = {}
    for s in sorted(lexicon.surnames, reverse=True):
        by_kana[lexicon.surnames[s][0]] = ("s", s)
    heads = {k: v[1] for k, v in by_kana.items()}
    tails = {lexicon.given[g][0]: g for g in sorted(lexicon.given, reverse=True)}
    latin_heads = {skeleton(romaji(k)): v for k, v in sorted(heads.items(), reverse=True)}
    latin_tails = {skeleton(romaji(k)): v for k, v in sorted(tails.items(), reverse=True)}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for place, core, kind in zip(batch["place"], batch["core"], batch["kind"], strict=True):
                first, last = (heads, tails) if kind == "a" else (latin_heads, latin_tails)
                for i, j in [(i, j) for i in range(1, len(core)) for j in (i, i - 1)]:  # parts may share a joined letter
                    a, b = core[:i], core[j:]
                    if i != j and kind != "l":
                        continue
                    pair = (first[a], last[b]) if a in first and b in last else (first[b], last[a]) if b in first and a in last else None
                    if pair:
                        rows.append((place, core, core, core, kind, *pair))
                        break
            yield pd.DataFrame(rows, columns=["place", "core", "alt", "turned", "kind", "surname", "given"])

    return cores.where("kind IN ('a', 'l')").mapInPandas(read, _CORE).dropDuplicates(["place", "surname", "given"])


def components(edges: DataFrame) -> DataFrame:
    """``place, core, root``: the least core that each core of the edges ``place, core, to`` hangs together with.

    In each round a core takes the least root among its neighbours, and then that one's root, so the
    rounds grow with the logarithm of the longest chain.  Every round is a table in the shared folder.
    """
    both = materialize(edges.select("place", "core", "to").unionByName(edges.select("place", F.col("to").alias("core"), F.col("core").alias("to"))).distinct())
    roots = materialize(both.groupBy("place", "core").agg(F.min("to").alias("n")).select("place", "core", F.least("core", "n").alias("root")))
    while True:
        near = both.join(roots.select("place", F.col("core").alias("to"), "root"), ["place", "to"]).groupBy("place", "core").agg(F.min("root").alias("n"))
        step = roots.join(near, ["place", "core"]).select("place", "core", F.col("root").alias("was"), F.least("root", "n").alias("root"))
        jump = roots.select("place", F.col("core").alias("root"), F.col("root").alias("further"))
        new = materialize(step.join(jump, ["place", "root"], "left").select("place", "core", "was", F.coalesce("further", "root").alias("root")))
        settled = new.where("was <> root").isEmpty()
        release(roots)
        roots = new
        if settled:
            release(both)
            return roots.select("place", "core", "root")


def link_spellings(names: DataFrame, place: str, written: str, lexicon_rows: list) -> DataFrame:
    """``place, written, person``: the person each distinct spelling of a place stands for, one row each.

    ``person`` names the group inside its place: the kanji of a registered name, or ``=`` with the least core of
    the spellings that hang together without one.  Spellings to which two registered persons are alike near
    stand for themselves, together with the spellings of the same core.

    * Null places or names, and names without a letter (empty, blank, marks only), give no row.
    * Repeated rows give one row; extra columns are ignored; an empty table gives no row, an empty lexicon links names with names only.
    * A very long text is looked up like any other.

    All joins are on (place, segment), so neither a place nor a person with many spellings
    makes one large group; the groups are only counted by their least and greatest.
    """
    lexicon = Lexicon.of(lexicon_rows)
    each = names.select(F.col(place).cast("string").alias("place"), F.col(written).cast("string").alias("written")).where("place IS NOT NULL AND written IS NOT NULL").distinct()
    parsed = materialize(_cores(each, lexicon).where("kind <> ''"))
    # of the spellings that fold to one core, one that reads as a registered name makes it a registered person
    as_read = F.min(F.when(F.col("surname").isNotNull(), F.struct("surname", "given"))).alias("name")
    cores = parsed.groupBy("place", "core", "kind").agg(F.min("alt").alias("alt"), F.min("turned").alias("turned"), as_read)
    cores = materialize(cores.select("place", "core", "alt", "turned", "kind", "name.surname", "name.given"))
    named = cores.where("surname IS NOT NULL").select("place", "core", F.translate(F.concat("surname", "given"), *_FOLDED).alias("person"))
    others = cores.where("surname IS NULL")
    registered = parsed.where("surname IS NOT NULL").dropDuplicates(["place", "surname", "given"]).drop("written")  # also those that fold to one
    first = materialize(_nearest(_hits(others, _index(registered, lexicon))))
    left = materialize(others.join(first, ["place", "core"], "left_anti"))
    second = materialize(_nearest(_hits(left, _index(_readable(left, lexicon), lexicon))))
    alone = materialize(left.join(second, ["place", "core"], "left_anti"))
    edges = _hits(alone, _index(alone, lexicon)).where("to <> core")
    groups = components(edges).select("place", "core", F.concat(F.lit("="), "root").alias("person"))
    release(left, alone)
    linked = named.unionByName(first.where("person IS NOT NULL")).unionByName(second.where("person IS NOT NULL")).unionByName(groups)
    out = parsed.select("place", "written", "core").join(linked, ["place", "core"], "left")
    return out.select("place", "written", F.coalesce("person", F.concat(F.lit("="), "core")).alias("person"))


_FOLDED = "".join(c for g in LOOKALIKES for c in g[1:]), "".join(g[0] for g in LOOKALIKES for _ in g[1:])


def spelling_classes(linked: DataFrame) -> DataFrame:
    """``place, written, class_id, links``: a row for each spelling with the least spelling of its person and the number of the others.

    The form of the result that grows with the spellings and not with their pairs.
    """
    person = linked.groupBy("place", "person").agg(F.min("written").alias("class_id"), (F.count("*") - 1).alias("links"))
    return linked.join(person, ["place", "person"]).select("place", "written", "class_id", "links")


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """``place, name_a, name_b``: every two spellings of a person, name_a before name_b by code point."""
    a = linked.select("place", "person", F.col("written").alias("name_a"))
    b = linked.select("place", "person", F.col("written").alias("name_b"))
    return a.join(b, ["place", "person"]).where("name_a < name_b").select("place", "name_a", "name_b")
