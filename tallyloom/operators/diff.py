"""Field-by-field comparison of a form with its ledger row, and the status of the pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.text import blank, join_list, norm_tablet, or_placeholder


def _ledger_list(fields: list[str]) -> Column:
    return F.array(*[F.col(f"r.{c}") for c in fields])


def field_pairs() -> list[tuple[str, Column, Column, Column]]:
    """(label, form value as text, ledger value as text, differs) of the seven compared fields, in order."""
    out = []
    for label, name in S.FIELDS:
        if name in ("left_totals", "right_totals"):
            other = _ledger_list(S.LEFT if name == "left_totals" else S.RIGHT)
            out.append((label, join_list(F.col(name)), F.array_join(other, "/"), F.coalesce(F.col(name), F.array().cast("array<string>")) != other))
        elif name == "tablet_no":
            out.append((label, F.col(name), F.col(f"r.{name}"), ~norm_tablet(F.col(name)).eqNullSafe(norm_tablet(F.col(f"r.{name}")))))
        else:
            out.append((label, F.col(name), F.col(f"r.{name}"), blank(F.col(name)) != blank(F.col(f"r.{name}"))))
    return out


def with_diffs(matched: DataFrame) -> DataFrame:
    """Adds ``diffs ARRAY<STRUCT<field, form_value, csv_value>>``: the fields that differ; empty without a ledger row."""
    each = F.array(*[
        F.when(differs, F.struct(F.lit(label).alias("field"), or_placeholder(form, S.UNREAD).alias("form_value"), blank(other).alias("csv_value")))
        for label, form, other, differs in field_pairs()
    ])
    none = F.array().cast("array<struct<field:string,form_value:string,csv_value:string>>")
    return matched.withColumn("diffs", F.when(F.col("r").isNotNull(), F.array_compact(each)).otherwise(none))


def messages(diffs: Column) -> Column:
    """Diffs as texts."""
    return F.transform(diffs, lambda d: F.concat(d["field"], F.lit(": 帳票="), d["form_value"], F.lit(", CSV="), d["csv_value"]))


def with_status(matched: DataFrame, mode: str = "csv") -> DataFrame:
    """Adds ``status, differences, review_reasons`` to the result of :func:`with_diffs`.

    In this order: no row, several rows, review asked for (differences stay empty, the row stays),
    any difference, none.  In mode ``pdf`` a form to be reviewed without any totals has the totals
    message as its only reason, whatever was found.
    """
    no_text = F.array().cast("array<string>")
    found, many = F.col("n_candidates") > 0, F.col("n_candidates") > 1
    differs = F.size("diffs") > 0
    clear = found & ~many & ~F.col("needs_review")
    status = F.when(clear & ~differs, S.MATCH).when(clear, S.MISMATCH).otherwise(S.REVIEW)
    reasons = (
        F.when(~found, F.array(F.lit(S.NO_RECORD)))
        .when(many, F.array(F.concat(F.lit("複数の候補レコードが見つかりました（"), F.col("n_candidates").cast("string"), F.lit("件）"))))
        .when(F.col("needs_review"), F.array(F.lit(S.TOTALS_UNREAD)))
        .otherwise(no_text)
    )
    if mode == "pdf":
        empty = (F.coalesce(F.size("left_totals"), F.lit(0)) <= 0) & (F.coalesce(F.size("right_totals"), F.lit(0)) <= 0)
        reasons = F.when(F.col("needs_review") & empty, F.array(F.lit(S.TOTALS_UNREAD))).otherwise(reasons)
    return matched.withColumn("status", status).withColumn("differences", F.when(clear, messages(F.col("diffs"))).otherwise(no_text)).withColumn("review_reasons", reasons)


def totals_agree(tally: Column, total: Column, parts: Column) -> Column:
    """Whether a tally, a printed total and the sum of its parts agree; null if any of them is missing."""
    summed = F.aggregate(parts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.when(tally.isNotNull() & total.isNotNull() & summed.isNotNull(), (tally == total) & (total == summed))
