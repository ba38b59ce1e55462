"""Column functions on texts, all null-safe and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def trim_u(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def parse_totals(c: Column) -> Column:
    """``a / b//c`` as [a, b, c]: parts at slashes, trimmed, blank ones dropped; null and blank give []."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "/"), trim_u), lambda x: x != "")


def blank_to_null(c: Column) -> Column:
    """Only the empty text becomes null."""
    return F.nullif(c, F.lit(""))


def blank(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def parse_flag(c: Column) -> Column:
    """True for ``true`` in any case, without trimming; else false, also for null."""
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def norm_tablet(c: Column) -> Column:
    """Tablet number for matching: no ASCII space, ``¶`` as ``it``, lower case; null and empty are null, a space alone is empty."""
    return F.lower(F.replace(F.replace(blank_to_null(c), F.lit(" "), F.lit("")), F.lit("¶"), F.lit("it")))


def or_placeholder(c: Column, shown: str) -> Column:
    """The text, or ``shown`` where it is null or empty."""
    return F.coalesce(blank_to_null(c), F.lit(shown))


def join_list(c: Column, mark: str = "/") -> Column:
    """Elements with ``mark`` between them; null gives the empty text."""
    return F.coalesce(F.array_join(c, mark), F.lit(""))


def list_repr(c: Column) -> Column:
    """``['a', 'b']``; empty and null lists give the empty text."""
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))).otherwise("")


def to_whole(c: Column) -> Column:
    """Text as a whole number, cut toward zero; ``true`` is 1, ``false`` 0; anything else and infinite values are null."""
    number = F.when(F.lower(c) == "true", F.lit(1.0)).when(F.lower(c) == "false", F.lit(0.0)).otherwise(trim_u(c).try_cast("double"))
    return F.when(F.abs(number) < 9.2e18, number.try_cast("bigint"))


def to_real(c: Column) -> Column:
    """Text as a double, or null."""
    return F.when(F.lower(c) == "true", F.lit(1.0)).when(F.lower(c) == "false", F.lit(0.0)).otherwise(trim_u(c).try_cast("double"))
