"""Probabilistic linkage of readings to ledger records that share no usable key.

Several blocking passes propose pairs; each pair is compared field by field at agreement
levels; expectation-maximisation over the counts of the comparison patterns estimates how
often matches and non-matches show each level; the posterior is the confidence of a match.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.names import Lexicon, core_of, fold, kind_of, name_unifier
from tallyloom.llm.people import link_spellings
from tallyloom.llm.places import resolve_places
from tallyloom.llm.unify import published_table
from tallyloom.operators.packed import split_packed
from tallyloom.tables import materialize, release, scratch

#: Levels of each comparison, from agreement to disagreement; -1 where a side is missing.
LEVELS = {"date": 3, "store": 2, "person": 2, "tablet": 4, "left": 4, "right": 3, "number": 4}
#: A value on more than this share of the ledger's rows has its pairs compared where they meet; at most 1 / HOT values are.
#: This and ``PLAIN_ROWS`` decide on the plan only: pairs, model, links and candidates are the same either way.
HOT = 0.001
#: Rows up to which a value's pairs are collected first in any case.
PLAIN_ROWS = 5_000
#: Parts of a hot block.
SALTS = 8
THRESHOLD = 0.5


def _digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def day_of(c: Column) -> tuple[Column, Column]:
    """Year (null if not written) and month with day (``mmdd``) of a date in any of the usual notations."""
    full = r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?$"
    plain = r"^(\d{4})(\d{2})(\d{2})$"
    short = r"^'?(\d{2})[-/.](\d{1,2})[-/.](\d{1,2})$"
    era = r"^(?:R|Ｒ|令和)(\d{1,2}|元)[-/.年](\d{1,2})[-/.月](\d{1,2})日?$"
    bare = r"^(\d{1,2})[-/.月](\d{1,2})日?$"

    def pick(t: Column, full_i: int, bare_i: int | None) -> Column:
        out = F.lit(None).cast("string")
        for p in (bare, short, era, plain, full):
            i = bare_i if p is bare else full_i
            if i is not None:
                value = F.regexp_extract(t, p, i)
                if i == 1 and p is short:
                    value = F.concat(F.lit("20"), value)
                if i == 1 and p is era:
                    value = (F.lit(2018) + F.replace(value, F.lit("元"), F.lit("1")).try_cast("int")).cast("string")
                out = F.when(F.regexp(t, F.lit(p)), value).otherwise(out)
        return out

    def read(v: Column) -> Column:
        t = F.regexp_replace(_digits(v), r"[\s\p{Z}]", "")
        return F.struct(pick(t, 1, None).alias("y"), F.concat(F.lpad(pick(t, 2, 1), 2, "0"), F.lpad(pick(t, 3, 2), 2, "0")).alias("d"))

    iso = F.regexp(c, F.lit(r"^\d{4}-\d{2}-\d{2}$"))  # by far the most
    # as a function of an element the others stay out of the generated method, which the JVM doesn't compile beyond 8,000 bytes
    other = F.get(F.transform(F.array(c), read), F.lit(0))
    return F.when(iso, F.substring(c, 1, 4)).otherwise(other["y"]), F.when(iso, F.concat(F.substring(c, 6, 2), F.substring(c, 9, 2))).otherwise(other["d"])


def _numbers(c: Column) -> Column:
    """First number of each value packed in ``c``, without thousands marks."""
    plain = F.regexp(c, F.lit(r"^[0-9]+(?:/[0-9]+)*\z"))  # most are, and need no grammar
    return F.when(plain, F.split(c, "/")).otherwise(F.filter(F.transform(split_packed(c), lambda s: F.regexp_extract(F.replace(_digits(s["item"]), F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0)), lambda x: x != ""))


def _tablet(c: Column) -> Column:
    """A tablet number in one form; look-alike marks and widths settled, null if blank."""
    t = F.translate(c, "０１２３４５６７８９〜∼˜～－−", "0123456789~~~~~~")
    t = F.upper(F.regexp_replace(F.replace(t, F.lit("-"), F.lit("~")), r"[\s\p{Z}\p{Cf}]", ""))
    t = F.translate(t, "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺΑΒΕΖΗΚΜΝΡΤΧАВЕКМНРСТХЅ", "ABCDEFGHIJKLMNOPQRSTUVWXYZABEZHKMNPTXABEKMHPCTXS")
    return F.nullif(t, F.lit(""))


def _signature(c: str) -> Column:
    """Hash of the totals of a side in any order; null without one."""
    return F.when(F.size(c) > 0, F.xxhash64(F.sort_array(c)))


def unkeyed(readings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Readings whose number, without outer U+0020, is null, empty or that of no ledger row; each distinct row once."""
    number = F.trim(F.col("daily_report_no"))
    known = ledger.select(F.col("daily_report_no").alias("_known")).where("_known IS NOT NULL").distinct()
    return readings.join(known, F.when(number != "", number) == F.col("_known"), "left_anti").dropDuplicates()


def _names(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Distinct staff texts with their core, for readings whose store is unknown."""
    args = (tuple(lexicon.surnames), tuple(lexicon.kana_words()), published_table(df.sparkSession))

    @F.pandas_udf("string")
    def core(values):
        unify = name_unifier(*args)
        return values.map(lambda v: None if v is None else (lambda c: fold(c) if kind_of(c) else None)(core_of(unify(v)).core))

    return df.select(F.col("staff_name").alias("w")).where("w IS NOT NULL").distinct().withColumn("core", core("w"))


def _attributes(readings: DataFrame, ledger: DataFrame, stores: DataFrame, lexicon_rows: list) -> tuple[DataFrame, DataFrame]:
    """Both sides, written, with comparable attributes: y, d, s, p, t, n, left, right, and the signatures ls and rs of the totals."""
    lexicon = Lexicon.of(lexicon_rows)
    means = materialize(resolve_places(readings, "store_name", stores, "store_name", lexicon_rows))
    placed = readings.join(means, F.col("store_name") == F.col("written"), "left").drop("written").withColumnRenamed("place", "s")
    written = ledger.select(F.col("store_name").alias("s"), "staff_name").unionAll(placed.select("s", "staff_name")).distinct()
    people = materialize(link_spellings(written, "s", "staff_name", lexicon_rows))
    people = people.select(F.col("place").alias("_s"), F.col("written").alias("_w"), F.col("person").alias("p"))

    def with_person(df: DataFrame) -> DataFrame:
        return df.join(people, (F.col("s") == F.col("_s")) & (F.col("staff_name") == F.col("_w")), "left").drop("_s", "_w")

    number = F.nullif(_digits(F.trim(F.col("daily_report_no"))), F.lit(""))
    year, day = day_of(F.col("date"))
    form = with_person(placed).join(_names(readings.where("store_name IS NULL"), lexicon), F.col("staff_name") == F.col("w"), "left").select(
        F.col("reading_id").alias("rid"), year.alias("y"), day.alias("d"), "s", F.coalesce("p", F.when(F.col("s").isNull(), F.col("core"))).alias("p"),
        _tablet(F.col("tablet_no")).alias("t"), number.alias("n"), _numbers(F.col("left_totals")).alias("left"), _numbers(F.col("right_totals")).alias("right"), "single",
    )

    def listed(*cols: str) -> Column:
        return F.array_remove(F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in cols]), "")

    # taken apart where the ledger is read: behind the join all of it would be one generated method, too long to be compiled
    parsed = ledger.select(
        "record_id", year.alias("y"), day.alias("d"), F.col("store_name").alias("s"), "staff_name", _tablet(F.col("tablet_no")).alias("t"), number.alias("n"),
        listed("left_total_1", "left_total_2", "left_total_3").alias("left"), listed("right_total_1", "right_total_2").alias("right"),
    )
    rows = with_person(parsed).select("record_id", "y", "d", "s", "p", "t", "n", "left", "right")
    form, rows = (x.withColumn("ls", _signature("left")).withColumn("rs", _signature("right")) for x in (form, rows))
    rows = materialize(rows.withColumn("lid", F.monotonically_increasing_id()), keep=True)
    return materialize(_flagged(form, rows).withColumn("fid", F.monotonically_increasing_id()), keep=True), rows


def _repeated(df: DataFrame, key: str) -> DataFrame:
    """``_k``: keys of several rows."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k")


def _flagged(form: DataFrame, rows: DataFrame) -> DataFrame:
    """The readings with ``shared``, whether the ledger has their tablet in several stores."""
    store = F.xxhash64("s")
    shared = rows.where("t IS NOT NULL AND s IS NOT NULL").groupBy(F.col("t").alias("_t")).agg(F.min(store).alias("a"), F.max(store).alias("b")).where("a <> b").select("_t")
    # readings without a tablet are spread by their id instead of meeting at null
    return form.join(shared, F.coalesce("t", F.concat(F.lit(" "), F.col("rid").cast("string"))) == F.col("_t"), "left").withColumn("shared", F.col("_t").isNotNull()).drop("_t")


def _hot(rows: DataFrame) -> dict[str, list[str]]:
    """Stores, persons and tablets on more than ``HOT`` of the rows; at most ``3 / HOT`` values whatever the size."""
    total = rows.count()
    out = {}
    for c in ("s", "p", "t"):
        many = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") > max(total * HOT, PLAIN_ROWS))
        out[c] = [r[0] for r in many.collect()]
    return out


def _each_two(items: Column, *of: Column) -> Column:
    """A hash of ``of`` with each two values of an array, at any positions and in either order; each once, among nulls."""
    x = F.sort_array(items)
    at = [F.get(x, F.lit(i)) for i in range(3)]

    def two(i: int, j: int) -> Column:
        return F.when(F.size(x) > j, F.xxhash64(*of, at[i], at[j]))

    three = F.array(two(0, 1), F.when(at[1] != at[2], two(0, 2)), F.when(at[0] != at[1], two(1, 2)))  # compiled, as functions of elements aren't
    more = F.flatten(F.transform(x, lambda v, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda w: F.xxhash64(*of, v, w))))
    return F.when(F.size(x) <= 3, three).otherwise(F.array_distinct(more))


def _with_blocks(df: DataFrame, hot: dict[str, list[str]]) -> DataFrame:
    """Adds ``cold`` and ``hot``: hashes of the blocks of a row, and of those of a hot value.

    Day with person, store or tablet.  For missing and wrong days person with all totals, and person in
    store with the tablet, the right totals, each two of the left ones or the only left one.  Last five
    digits of the number with day or store.
    """

    def keyed(name: str, *cols: Column) -> Column:
        whole = F.lit(True)
        for c in cols:
            whole = whole & c.isNotNull()
        return F.when(whole, F.xxhash64(F.lit(name), *cols))

    d, s, p, t, ls, rs = (F.col(c) for c in ("d", "s", "p", "t", "ls", "rs"))
    tail = F.when(F.length("n") >= 5, F.substring(F.col("n"), -5, 5))
    none = F.array().cast("array<bigint>")
    two = F.when(s.isNotNull() & p.isNotNull(), _each_two(F.col("left"), F.lit("two"), s, p)).otherwise(none)
    one = F.when(F.size("left") == 1, keyed("left", s, p, ls))  # equal lists of more have two in common
    of = {
        "p": F.concat(F.array(keyed("p", d, p), keyed("totals", p, ls, rs), one, keyed("tablet", s, p, t), keyed("right", s, p, rs)), two),
        "s": F.array(keyed("s", d, s)),
        "t": F.array(keyed("t", d, t)),
    }
    cold, warm = [F.array(keyed("tail day", tail, d), keyed("tail store", tail, s))], [none]
    for c, keys in of.items():
        is_hot = F.coalesce(F.col(c).isin(hot[c]), F.lit(False)) if hot[c] else F.lit(False)
        cold.append(F.when(is_hot, none).otherwise(keys))
        if hot[c]:
            warm.append(F.when(is_hot, keys).otherwise(none))
    return df.withColumn("cold", F.concat(*cold)).withColumn("hot", F.array_compact(F.concat(*warm)))


def _blocks(df: DataFrame, key: str) -> DataFrame:
    """``key, b``: the blocks of a row that aren't of a hot value."""
    # outer, as for the other Spark filters by the size of the array and so works it out twice
    return df.select(key, F.explode_outer("cold").alias("b")).where("b IS NOT NULL")


def _met(left: DataFrame, right: DataFrame, repeated: DataFrame) -> DataFrame:
    """All pairs of the hot blocks with ``f`` and ``g``, each once, straight from the join and without a shuffle of pairs.

    The ledger side of a block is cut into ``SALTS`` parts, each of which meets all its readings.  ``single``: neither the
    reading nor the record, by the ``repeated`` ones, has another row.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = left.select("rid", "f", F.explode("f.hot").alias("b")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = right.where(F.size("g.hot") > 0).join(repeated, F.col("g.record_id") == F.col("_k"), "left")
    g = marked.select("g", F.col("_k").isNull().alias("one"), F.explode("g.hot").alias("b"), F.pmod(F.xxhash64("lid"), F.lit(SALTS)).cast("int").alias("salt"))
    # a fixed number of partitions, as the work is that of the pairs and not that of the rows
    met = f.repartition(n, "b", "salt").join(g.repartition(n, "b", "salt"), ["b", "salt"]).where((F.size("f.hot") == 1) | (F.size("g.hot") == 1) | (F.get(F.array_intersect("f.hot", "g.hot"), F.lit(0)) == F.col("b")))
    return met.withColumn("single", F.col("f.single") & F.col("one"))


def _compare(pairs: DataFrame) -> DataFrame:
    """The ``pattern`` of levels of pairs with the attributes ``f`` and ``g``, whether they are in the ``sample``, whether they ``teach``.

    The sample has the pairs of one day, of one tail of the number or with the same left totals.  The
    others were only looked up as they agree in store and person, which says nothing of them.  Nor do
    pairs say anything that have only the day and a tablet of several stores in common: they don't teach the model,
    which judges them all the same.
    """

    def both(c: str) -> Column:
        return F.col(f"f.{c}").isNotNull() & F.col(f"g.{c}").isNotNull()

    same_year = ~both("y") | (F.col("f.y") == F.col("g.y"))
    date = F.when(~both("d"), -1).when((F.col("f.d") == F.col("g.d")) & same_year, 0).when((F.levenshtein("f.d", "g.d", 1) >= 0) & same_year, 1).otherwise(2)
    store = F.when(~both("s"), -1).when(F.col("f.s") == F.col("g.s"), 0).otherwise(1)
    known = both("p") & ~F.startswith(F.col("f.p"), F.lit("=")) & ~F.startswith(F.col("g.p"), F.lit("="))
    person = F.when(both("p") & (F.col("f.p") == F.col("g.p")), 0).when(~known, -1).otherwise(1)
    part = F.contains(F.col("g.t"), F.col("f.t")) | (F.levenshtein("f.t", "g.t", 1) >= 0)
    tablet = F.when(~both("t"), -1).when(F.col("f.t") == F.col("g.t"), F.when(F.col("f.shared"), 1).otherwise(0)).when(part, 2).otherwise(3)

    def totals(c: str, close: int) -> Column:
        f, g = F.col(f"f.{c}"), F.col(f"g.{c}")
        x, y, z = (F.get(f, F.lit(i)) for i in range(3))
        each = [F.array_contains(g, x), (x != y) & F.array_contains(g, y), (x != z) & (y != z) & F.array_contains(g, z)]
        few = sum((F.when(c, 1).otherwise(0) for c in each), F.lit(0))
        # without a set for each pair; a function of elements in it keeps the levels out of the join's generated method, which the JVM doesn't compile beyond 8,000 bytes
        shared_items = F.when(F.size(f) <= 3, few).otherwise(F.size(F.filter(F.array_distinct(f), lambda v: F.array_contains(g, v))))
        level = F.when((F.size(f) == 0) | (F.size(g) == 0), -1).when(f == g, 0)
        if close > 1:  # the same totals in another order are two at least
            return level.otherwise(F.get(F.array(*map(F.lit, (3, 2, 1))), F.least(shared_items, F.lit(2))))
        return level.when(shared_items >= 1, 1).otherwise(2)

    f, g = F.col("f.n"), F.col("g.n")
    cut = (F.length(f) < F.length(g)) & (F.length(f) >= 5) & (F.startswith(g, f) | F.endswith(g, f))
    # up to three letters misread in numbers of one length, where a single one is near: by the edits, from -1 for more
    misread = F.get(F.array(*map(F.lit, (3, 0, 1, 2, 2))), F.levenshtein(f, g, 3) + 1)
    number = F.when(~both("n"), -1).when(f == g, 0).when(F.length(f) == F.length(g), misread).when(cut | (F.levenshtein(f, g, 1) >= 0), 1).otherwise(3)
    levels = {"date": date, "store": store, "person": person, "tablet": tablet, "left": totals("left", 2), "right": totals("right", 1), "number": number}
    tail = F.coalesce((F.length(f) >= 5) & (F.substring(f, -5, 5) == F.substring(g, -5, 5)), F.lit(False))
    day, own_tablet, own_store, own_person = (F.coalesce(F.col(f"f.{c}") == F.col(f"g.{c}"), F.lit(False)) for c in ("d", "t", "s", "p"))
    same = (F.size("f.left") > 0) & (F.size("f.left") == F.size("g.left")) & (F.sort_array("f.left") == F.sort_array("g.left"))
    teach = ~(day & own_tablet & F.col("f.shared")) | own_store | own_person | tail
    pattern = sum((F.shiftleft(levels[k] + 1, 3 * i) for i, k in enumerate(LEVELS)), F.lit(0))
    return pairs.select("rid", F.col("g.record_id").alias("record_id"), pattern.alias("pattern"), (day | same | tail).alias("sample"), teach.alias("teach"), "single")


def _levels(pattern: int) -> tuple[int, ...]:
    """The level of each comparison in a pattern, which has three bits for each."""
    return tuple((pattern >> 3 * i & 7) - 1 for i in range(len(LEVELS)))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Share of matches and, for each comparison, the level probabilities among matches and non-matches.

    Expectation-maximisation over pattern counts; missing comparisons say nothing.  It starts from
    agreement being usual among matches; probabilities stay off 0, so one level never decides alone.
    """
    sizes = list(LEVELS.values())
    x = np.array([p for p, _ in patterns], dtype=int).reshape(-1, len(sizes))
    w = np.array([n for _, n in patterns], dtype=float)
    m = [np.array([0.9] + [0.1 / (k - 1)] * (k - 1)) for k in sizes]
    u = [np.array([0.1] + [0.9 / (k - 1)] * (k - 1)) for k in sizes]
    share = 0.1
    for _ in range(rounds):
        post = posterior(x, share, m, u)
        before = share
        share = float(np.clip((w * post).sum() / max(w.sum(), 1), 1e-6, 1 - 1e-6))
        for j, k in enumerate(sizes):
            for target, weight in ((m, w * post), (u, w * (1 - post))):
                counts = np.array([weight[x[:, j] == level].sum() for level in range(k)]) + 0.5
                target[j] = counts / counts.sum()
        if abs(share - before) < 1e-9:
            break
    return share, m, u


def posterior(x: np.ndarray, share: float, m: list[np.ndarray], u: list[np.ndarray]) -> np.ndarray:
    """Probability of a match for each pattern."""
    odds = np.full(len(x), np.log(share / (1 - share)))
    for j in range(x.shape[1]):
        seen = x[:, j] >= 0
        odds[seen] += np.log(m[j][x[seen, j]] / u[j][x[seen, j]])
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _judged(counts: list[tuple[tuple[int, ...], bool, bool, int]]) -> list[tuple]:
    """The levels of each pattern, ``sample`` and its posterior, from (pattern, sample, teach, number of pairs).

    The sample's model is that of its own pairs; those outside it are held against all pairs.  Pairs that don't
    teach are left out of either, but where there are no others.
    """
    out = []
    for sample in sorted({s for _, s, _, _ in counts}):
        drawn: dict[tuple[int, ...], int] = {}
        for teaching in (True, False):
            for pattern, s, t, n in counts:
                if t == teaching and (s or not sample):
                    drawn[pattern] = drawn.get(pattern, 0) + n
            if drawn:
                break
        patterns = sorted({p for p, s, _, _ in counts if s == sample})
        out += [(p, sample, float(c)) for p, c in zip(patterns, posterior(np.array(patterns, dtype=int), *estimate(sorted(drawn.items()))), strict=True)]
    return out


def link_records(readings: DataFrame, ledger: DataFrame, stores: DataFrame, lexicon_rows: list, threshold: float = THRESHOLD) -> DataFrame:
    """``reading_id, record_id, confidence, candidates``: for each reading without a usable number its likeliest ledger record.

    * At most one record a reading, the likeliest one, of equals that with the least record_id;
      none whose own posterior is below ``threshold``.  A record may serve several readings.
    * ``candidates`` is the number of records at or above the threshold, and ``confidence`` the probability of the
      chosen one among them and none at all: of two equals each has a half at most.
    * Null fields compare as missing.  Resends give one link; every state of a record is compared, its best one holds.
    * Readings without any two comparable fields, null reading ids, and empty tables give no row.
    """
    spark = readings.sparkSession
    chosen = materialize(unkeyed(readings.select("reading_id", "date", "store_name", "staff_name", "daily_report_no", "tablet_no", "left_totals", "right_totals").where("reading_id IS NOT NULL"), ledger).withColumn("single", F.count("*").over(Window.partitionBy("reading_id")) == 1))
    with scratch():  # the tables of places and people aren't needed once both sides have their attributes
        forms, rows = _attributes(chosen, ledger, stores, lexicon_rows)
    forms_table, rows_table = forms, rows
    hot = _hot(rows)
    forms, rows = _with_blocks(forms, hot), _with_blocks(rows, hot)
    # each once, where they meet the readings anyway
    pairs = _blocks(forms, "fid").join(_blocks(rows, "lid"), "b").select("fid", "lid").repartition("fid").distinct()

    def form_side(df: DataFrame) -> DataFrame:
        return df.select("fid", "rid", F.struct("y", "d", "s", "p", "t", "n", "left", "right", "hot", "shared", "single").alias("f"))

    def row_side(df: DataFrame) -> DataFrame:
        return df.select("lid", F.struct("record_id", "y", "d", "s", "p", "t", "n", "left", "right", "hot").alias("g"))

    left, right = form_side(forms), row_side(rows)
    kinds = ["pattern", "sample", "teach", "single"]
    compared = _compare(pairs.join(left, "fid").join(right, "lid").where(~F.arrays_overlap("f.hot", "g.hot")).withColumn("single", F.lit(False))).withColumn("n", F.lit(1).cast("long"))
    if any(hot.values()):
        # of equal patterns of a reading only the least record_id can win: all pairs count, one is kept; where a record or a reading has several rows, one for each record
        warm = reduce(or_, [F.col(c).isin(values) for c, values in hot.items() if values])  # by the columns, before a block is worked out
        met = _compare(_met(form_side(forms.where(warm)), row_side(rows.where(warm)), _repeated(rows, "record_id"))).groupBy("rid", *kinds, F.when(~F.col("single"), F.col("record_id"))).agg(F.min("record_id").alias("record_id"), F.count("*").alias("n"))
        compared = compared.unionByName(met.select("rid", "record_id", *kinds, "n"))
    compared = materialize(compared)
    release(chosen, forms_table, rows_table)
    counts = {(_levels(r["pattern"]), r["sample"], r["teach"]): r for r in compared.groupBy("pattern", "sample", "teach").agg(F.sum("n").alias("n")).collect()}  # bounded by the number of patterns
    code = {(levels, sample): r["pattern"] for (levels, sample, _), r in counts.items()}
    judged = _judged([(*k, r["n"]) for k, r in counts.items()])
    known = F.broadcast(spark.createDataFrame([(code[levels, sample], sample, c) for levels, sample, c in judged], "pattern INT, sample BOOLEAN, confidence DOUBLE"))
    # the states of a record are one candidate; records without others are counted and not listed
    odds = F.col("confidence") / F.greatest(1 - F.col("confidence"), F.lit(1e-12))
    likely = compared.join(known, ["pattern", "sample"]).where(F.col("confidence") >= threshold).withColumn("odds", odds)
    of = F.when(~F.col("single"), F.col("record_id")).alias("of")
    each = likely.groupBy("rid", of).agg(F.max(F.struct("odds", (-F.col("record_id")).alias("r"))).alias("b"), F.sum(F.col("odds") * F.col("n")).alias("all"), F.sum("n").alias("n"))
    alone = F.col("of").isNull()
    best = each.groupBy("rid").agg(F.max("b").alias("b"), F.sum(F.when(alone, F.col("all")).otherwise(F.col("b.odds"))).alias("all"), F.sum(F.when(alone, F.col("n")).otherwise(1)).alias("candidates"))
    return best.select(F.col("rid").alias("reading_id"), (-F.col("b.r")).alias("record_id"), (F.col("b.odds") / (F.col("all") + 1)).alias("confidence"), "candidates")
