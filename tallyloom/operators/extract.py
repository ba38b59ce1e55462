"""From the text of a reading model's answer to typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.text import blank, list_repr, to_real, to_whole, trim_u

_TEXT = ["date", "store", "name", "data_no", "tab_no", "notes"]


def fence_body(c: Column) -> Column:
    """The part of an answer that should be JSON: inside a json fence, else inside the first pair of fences, else all; trimmed."""
    tagged = F.split_part(F.split_part(c, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1))
    plain = F.split_part(c, F.lit("```"), F.lit(2))
    return trim_u(F.when(F.contains(c, F.lit("```json")), tagged).when(F.contains(c, F.lit("```")), plain).otherwise(c))


def parse_response(df: DataFrame, text: str) -> DataFrame:
    """Adds the struct ``raw`` of ten texts, ``parse_failed`` and ``error``.

    Text that is no JSON gives a struct of nulls with ``parse_failed`` true and no error, as do null and empty
    texts; JSON that isn't an object (a list, number or text) gives nulls and an error.
    """
    body = F.coalesce(fence_body(F.col(text)), F.lit(""))
    variant = F.try_parse_json(body)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(variant), F.lit("OBJECT")), F.lit(False))
    raw = F.from_json(F.when(is_object, body).otherwise(F.lit("{}")), S.RESPONSE_SCHEMA)
    failed = variant.isNull()
    return (
        df.withColumn("raw", raw)
        .withColumn("parse_failed", failed)
        .withColumn("error", F.when(~failed & ~is_object, F.lit("the answer is no JSON object")))
    )


def normalize_extraction(parsed: DataFrame) -> DataFrame:
    """Adds the typed fields of ``raw``: six texts (trimmed, blank is null), two whole numbers, two reals, two empty lists."""
    out = parsed
    for c in _TEXT:
        out = out.withColumn(c, F.nullif(trim_u(F.col(f"raw.{c}")), F.lit("")))
    for c in ("count", "total"):
        out = out.withColumn(c, to_whole(F.col(f"raw.{c}")))
    for c in ("left_total", "right_total"):
        out = out.withColumn(c, to_real(F.col(f"raw.{c}")))
    none = F.array().cast("array<string>")
    return out.withColumn("left_totals", none).withColumn("right_totals", none)


def to_forms(extracted: DataFrame, file_name: str, seq: str) -> DataFrame:
    """Extracted fields as forms.  Totals aren't read, so every form asks for review."""
    empty = (F.size("left_totals") == 0) | (F.size("right_totals") == 0)
    return extracted.select(
        F.col(file_name).alias("file_name"), "date", F.col("store").alias("store_name"), F.col("name").alias("staff_name"),
        F.col("data_no").alias("daily_report_no"), F.col("tab_no").alias("tablet_no"), "left_totals", "right_totals",
        ((blank(F.col("error")) != "") | empty).alias("needs_review"), F.col(seq).cast("bigint").alias("seq"),
    )


def page_status(extracted: DataFrame) -> DataFrame:
    """Adds ``page_status``: ok with both numbers and no error, else the error, else partial."""
    error = blank(F.col("error"))
    both = (blank(F.col("data_no")) != "") & (blank(F.col("tab_no")) != "")
    text = F.when((error == "") & both, S.PAGE_OK).when(error != "", F.concat(F.lit(S.PAGE_ERROR), error)).otherwise(S.PAGE_PARTIAL)
    return extracted.withColumn("page_status", text)


def page_success(pages: DataFrame) -> DataFrame:
    """One row: pages that are ok, and all."""
    return pages.agg(F.count_if(F.startswith("page_status", F.lit("[OK]"))).alias("ok"), F.count("*").alias("total"))


def page_name(n: Column) -> Column:
    """``page_01`` for 1."""
    return F.format_string("page_%02d", n)


def page_rows(pages: DataFrame) -> DataFrame:
    """The 13 text columns of the page file: lists as ``['a', 'b']``, null and absent columns blank."""
    kinds = dict(pages.dtypes)

    def shown(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        return list_repr(F.col(c)) if kinds[c].startswith("array") else blank(F.col(c).cast("string"))

    return pages.select(*[shown(c).alias(c) for c in S.PAGE])
