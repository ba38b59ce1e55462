"""Prioritised matching of forms with ledger rows, with detection of ambiguous keys.

The keys of the ledger are reduced to one index with a row per stage and key value: the number
of rows and the id of the only one.  The index is unique, so a join never multiplies forms,
and it is built with partial aggregation, so a hot key is one row after the map side.
Keys and row ids are 128-bit hashes: of fixed width, deterministic under recomputation, and
a row is looked up only where its key value is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.text import blank, norm_tablet, trim_u

#: Key of each stage by name: (label for one candidate, label for several).
LABELS = {"number": (S.BY_NUMBER, S.BY_NUMBER_MANY), "tablet": (S.BY_TABLET, S.BY_TABLET_MANY), "composite": (S.BY_COMPOSITE, S.BY_COMPOSITE_MANY)}

STAGES = ("number", "tablet", "composite")


def stage_keys(style: str = "exact") -> dict[str, list[Column]]:
    """Key expressions of the three stages, and of the first two together, on forms and ledger alike; null where the stage doesn't apply.

    ``exact``: texts as they are, tablets normalised.  ``trimmed``: all texts without outer white space.
    """
    def one(c: str) -> Column:
        return F.nullif(trim_u(F.col(c)) if style == "trimmed" else F.col(c), F.lit(""))

    tablet = norm_tablet(F.col("tablet_no")) if style == "exact" else one("tablet_no")
    return {
        "number": [one("daily_report_no")], "tablet": [tablet], "composite": [one("date"), one("store_name"), one("staff_name")],
        "both": [one("daily_report_no"), tablet],
    }


def with_row_id(ledger: DataFrame) -> DataFrame:
    """``ledger`` with the two halves of a hash of its ten fields."""
    cols = [blank(F.col(c)) for c in S.LEDGER]
    return ledger.withColumn("_h1", F.xxhash64(*cols)).withColumn("_h2", F.xxhash64(F.lit("second"), *reversed(cols)))


def _stage_key(number: int, parts: list[Column]) -> list[Column]:
    """A stage's key as ``stage, k1, k2``: its number and 128 bits of hash; stage is null where the stage doesn't apply."""
    there = F.lit(True)
    for p in parts:
        there = there & p.isNotNull()
    return [F.when(there, F.lit(number)).alias("stage"), F.xxhash64(F.lit(number), *parts).alias("k1"), F.xxhash64(F.lit("second"), *reversed(parts), F.lit(number)).alias("k2")]


def key_index(ledger: DataFrame, keys: dict[str, list[Column]]) -> DataFrame:
    """``stage, k1, k2, n, h1, h2``: one row for each key value of each stage, from one scan.  Identical ledger rows count each."""
    each = F.array(*[F.struct(*_stage_key(i, parts)) for i, parts in enumerate(keys.values())])
    rows = with_row_id(ledger).select("_h1", "_h2", F.inline(each)).where(F.col("stage").isNotNull())
    return rows.groupBy("stage", "k1", "k2").agg(F.count("*").alias("n"), F.min("_h1").alias("h1"), F.min("_h2").alias("h2"))


def _spread_by(forms: DataFrame) -> Column:
    """A hash of all that a form holds, to spread forms that look for nothing."""
    return F.xxhash64(*[F.col(f.name) for f in forms.schema.fields if "map<" not in f.dataType.simpleString()])


def _counted(forms: DataFrame, ledger: DataFrame, stages: tuple[str, ...], style: str) -> DataFrame:
    """``_f`` (all columns of a form), ``_any`` (its hash), and for each stage ``n_``, ``h1_`` and ``h2_``.  Nothing of a form can clash with them.

    All stages join the same index, whose exchange Spark reuses, so the ledger is read and shuffled once for all of them.
    A form that a stage doesn't apply to looks there for a stage of no row, under a hash of its own.
    """
    keys = {name: stage_keys(style)[name] for name in stages}
    index = key_index(ledger, keys)
    probes = []
    for i, (name, parts) in enumerate(keys.items()):
        stage, k1, k2 = _stage_key(i, parts)
        probes += [F.coalesce(stage, F.lit(-1)).alias(f"f_{name}"), F.when(stage.isNull(), _spread_by(forms)).otherwise(k1).alias(f"f1_{name}"), k2.alias(f"f2_{name}")]
    out = forms.select(F.struct("*").alias("_f"), _spread_by(forms).alias("_any"), *probes)
    for name in stages:
        named = index.select(F.col("stage").alias("_s"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("n").alias("_n"), F.col("h1").alias(f"h1_{name}"), F.col("h2").alias(f"h2_{name}"))
        on = (F.col(f"f_{name}") == F.col("_s")) & (F.col(f"f1_{name}") == F.col("_k1")) & (F.col(f"f2_{name}") == F.col("_k2"))
        out = out.join(named, on, "left").withColumn(f"n_{name}", F.coalesce("_n", F.lit(0))).drop("_s", "_k1", "_k2", "_n")
    return out.select("_f", "_any", *[f"{p}_{name}" for name in stages for p in ("n", "h1", "h2")])


def _unpacked(forms: DataFrame, added: list[str]) -> list[Column]:
    """The columns of a form that no added column replaces."""
    return [F.col("_f").getField(c).alias(c) for c in forms.columns if c not in added]


def count_candidates(forms: DataFrame, ledger: DataFrame, stages: tuple[str, ...] = STAGES, style: str = "exact") -> DataFrame:
    """``forms`` with ``n_<stage>``, 0 where a stage doesn't apply.  Columns of these names are replaced."""
    added = [f"n_{s}" for s in stages]
    return _counted(forms, ledger, stages, style).select(*_unpacked(forms, added), *added)


def cascade(forms: DataFrame, ledger: DataFrame, policy: str = "stop", style: str = "exact") -> DataFrame:
    """``forms`` with ``stage, matching_key, n_candidates, r``; every form stays, once.

    ``stop``: the first stage with a candidate decides, several candidates there make the form ambiguous.
    ``fallthrough``: the first stage with exactly one candidate decides, ambiguity goes on to the next stage.
    ``narrow``: like ``stop``, but several candidates by number are narrowed to those with the form's tablet.
    ``stage`` is null and ``matching_key`` says so where no stage decides.  ``r`` is the struct of the ledger
    row, null unless there is exactly one.  Empty ledger: nothing is found.  Repeated forms stay repeated.
    Other columns of the forms are kept, but those of the four names are replaced.
    """
    def n(s: str) -> Column:
        return F.col(f"n_{s}")

    hits = {"stop": [(s, s, n(s) > 0) for s in STAGES], "fallthrough": [(s, s, n(s) == 1) for s in STAGES]}
    if policy == "narrow":
        rules = [("number", "number", n("number") == 1), ("number", "both", (n("number") > 1) & (n("both") == 1)), *hits["stop"]]
    else:
        rules = hits[policy]

    def pick(value) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for stage, index, hit in rules:
            out = out.when(hit, value(stage, index))
        return out

    label = None
    for name, (single, many) in LABELS.items():
        value = F.when(F.col("n_candidates") == 1, single).otherwise(many)
        label = F.when(F.col("stage") == name, value) if label is None else label.when(F.col("stage") == name, value)
    used = STAGES + (("both",) if policy == "narrow" else ())
    decided = _counted(forms, ledger, used, style).withColumn("stage", pick(lambda s, i: F.lit(s))).withColumn("n_candidates", F.coalesce(pick(lambda s, i: n(i)), F.lit(0)))
    only = F.col("n_candidates") == 1
    decided = decided.select(
        "_f", "stage", "n_candidates", label.otherwise(S.NOT_FOUND).alias("matching_key"),
        # forms without a row get a key of their own, which spreads them over the partitions and equals no ledger row's
        F.when(only, pick(lambda s, i: F.col(f"h1_{i}"))).otherwise(F.col("_any")).alias("w1"), F.when(only, pick(lambda s, i: F.col(f"h2_{i}"))).alias("w2"),
    )
    rows = with_row_id(ledger).select("_h1", "_h2", F.struct(*[blank(F.col(c)).alias(c) for c in S.LEDGER]).alias("r"))
    found = decided.join(rows, (F.col("w1") == F.col("_h1")) & (F.col("w2") == F.col("_h2")), "left")
    added = ["stage", "matching_key", "n_candidates", "r"]
    return found.select(*_unpacked(forms, added), *added)


def unmatched(forms: DataFrame, ledger: DataFrame) -> DataFrame:
    """Forms without a candidate at any stage.  Repeated forms stay repeated."""
    none = F.lit(True)
    for s in STAGES:
        none = none & (F.col(f"n_{s}") == 0)
    return _counted(forms, ledger, STAGES, "exact").where(none).select(*_unpacked(forms, []))
