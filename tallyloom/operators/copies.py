"""Differences between two copies of a dataset.

Both sides are tagged, united and grouped once by key.  The group keeps one
struct per side, the latest row; the structs' fields are then compared by
generated higher-order expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType


def comparable(column: Column, kind: DataType) -> Column:
    """The form in which a value is compared, never null.

    Arrays are sets of messages: sorted, without repetition and null elements;
    null is the empty set.  All else is text without outer U+0020; null is the empty text.
    """
    if isinstance(kind, ArrayType):
        texts = F.transform(column, lambda x: x.cast("string"))
        return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(texts))), F.array().cast("array<string>"))
    return F.trim(F.coalesce(column.cast("string"), F.lit("")))


def compare_copies(
    first: DataFrame, second: DataFrame, key: str, version: str | None = None, ignore: tuple[str, ...] = ()
) -> DataFrame:
    """Rows that one copy lacks and, for keys in both, every field that differs.

    Returns ``row_key STRING, kind STRING, field STRING, first_value STRING, second_value STRING``:
    kind ``only_first`` or ``only_second`` (field is the empty text, values null), else ``differs``.

    * Of several rows of a key the one with the greatest ``version`` holds; a null version is
      the oldest.  Equal versions: the row whose compared fields are greatest, in both copies alike.
    * A null key is a key of its own, with a null ``row_key``.
    * Columns that only one copy has, and those of ``ignore``, aren't compared.
    * Empty copies: every key of the other side is reported; two empty copies give no row.

    One shuffle on the key.  Rows of a key are reduced to one per side before it, so
    neither a hot key nor many resends make a large group.
    """
    skip = {key, version, *ignore}
    other = dict(second.dtypes)
    fields = [f for f in first.schema.fields if f.name in other and f.name not in skip]

    def quoted(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    def side(df: DataFrame, n: int) -> DataFrame:
        values = [comparable(quoted(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(fields)]
        age = quoted(version) if version else F.lit(None).cast("timestamp")
        row = F.struct(age.alias("age"), *values) if values else F.struct(age.alias("age"))
        return df.select(quoted(key).cast("string").alias("row_key"), *(
            F.when(F.lit(n == side_no), row).alias(f"s{side_no}") for side_no in (1, 2)
        ))

    grouped = side(first, 1).unionByName(side(second, 2)).groupBy("row_key").agg(F.max("s1").alias("s1"), F.max("s2").alias("s2"))

    def shown(value: Column, kind: DataType) -> Column:
        return F.array_join(value, " | ") if isinstance(kind, ArrayType) else value

    pairs = F.array(*(
        F.struct(
            F.lit(f.name).alias("field"),
            (F.col(f"s1.f{i}") != F.col(f"s2.f{i}")).alias("differs"),
            shown(F.col(f"s1.f{i}"), f.dataType).alias("first_value"),
            shown(F.col(f"s2.f{i}"), f.dataType).alias("second_value"),
        )
        for i, f in enumerate(fields)
    )) if fields else F.array().cast("array<struct<field:string,differs:boolean,first_value:string,second_value:string>>")
    none = F.lit(None).cast("string")

    def missing(kind: str) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("field"), none.alias("first_value"), none.alias("second_value")))

    found = (
        F.when(F.col("s2").isNull(), missing("only_first"))
        .when(F.col("s1").isNull(), missing("only_second"))
        .otherwise(F.transform(F.filter(pairs, lambda p: p["differs"]), lambda p: F.struct(
            F.lit("differs").alias("kind"), p["field"].alias("field"), p["first_value"].alias("first_value"), p["second_value"].alias("second_value"),
        )))
    )
    return grouped.select("row_key", F.inline(found))
