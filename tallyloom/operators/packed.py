"""Several values packed in one text field, split into one row per value.

The grammar has ordered alternatives, tried from left to right:

    field   <- blank* open list close blank* / blank* list blank*     (one enclosing pair of brackets)
    list    <- slot (separator slot)*
    separator <- blank* mark blank* / blank+
    slot    <- quoted / bracketed / bare / nothing
    quoted  <- quote text quote, only if a separator or the end follows
    bare    <- characters that are neither mark nor blank

A quote that closes nowhere, or closes inside a value, makes ``quoted`` fail; the
slot is then read again as ``bare`` and flagged.  The alternatives are one
regular expression per field, so the work stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of quotes, and pairs of brackets.
QUOTES = [('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"), ("＂", "＂"), ("＇", "＇")]
BRACKETS = [("(", ")"), ("[", "]"), ("{", "}"), ("【", "】"), ("（", "）"), ("［", "］"), ("｛", "｝"), ("〔", "〕"), ("<", ">"), ("＜", "＞")]

BLANK = r"[\s\p{Z}\x{200B}\x{FEFF}]"
_QUOTE_CHARS = "".join(sorted({c for pair in QUOTES for c in pair}))
_BRACKET_CHARS = "".join("\\" + c if c in "[](){}" else c for pair in BRACKETS for c in pair)
#: A mark is punctuation or a symbol, but no quote, bracket, decimal point, per cent or currency sign.
MARK = rf"(?:[\p{{P}}\p{{S}}&&[^.．{_QUOTE_CHARS}{_BRACKET_CHARS}%％\p{{Sc}}]]|(?<![0-9０-９])[.．]|[.．](?![0-9０-９]))"
_END = rf"(?={BLANK}|{MARK}|\z)"


def _quoted(first: str, last: str) -> str:
    return f"{first}(?:[^{last}]|{last}{last})*+{last}{_END}" if first == last else f"{first}[^{last}]*+{last}{_END}"


_BRACKETED = "|".join(rf"\{a}[^\{a}\{b}]*+\{b}{_END}" for a, b in BRACKETS)
_SLOT = "|".join([*(_quoted(a, b) for a, b in QUOTES), _BRACKETED, rf"(?:(?!{MARK}|{BLANK})[\s\S])++", f"(?={BLANK}*{MARK})"])
#: One slot, captured, with the separator behind it.
SLOT = rf"\G{BLANK}*+({_SLOT}){BLANK}*+{MARK}?+"
_OUTER = "^" + BLANK + "+|" + BLANK + r"+\z"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _OUTER, "")


def split_packed(c: Column) -> Column:
    """``array<struct<pos INT, item STRING, malformed BOOLEAN>>`` of the values packed in ``c``.

    ``pos`` counts from 1 and also counts blank slots, which give no element.  ``item`` is without
    quotes, enclosing brackets and outer blanks.  ``malformed`` marks a slot with a quote or bracket
    that has no partner; it is read as bare and keeps its inner characters, without the stray quotes
    at its ends.  Null and blank fields give the empty array.
    """
    text = _strip(F.coalesce(c, F.lit("")))
    pairs, brackets = [x + y for x, y in QUOTES + BRACKETS], [x + y for x, y in BRACKETS]
    enclosed = "|".join(rf"\{a}[^\{a}\{b}]*(?:\{a}[^\{a}\{b}]*\{b}[^\{a}\{b}]*)*\{b}" for a, b in BRACKETS)

    def ends(x: Column) -> Column:
        return F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))

    whole = ends(text).isin(brackets) & F.regexp(text, F.lit(rf"\A(?:{enclosed})\z"))
    body = F.when(whole, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    slots = F.regexp_extract_all(body, F.lit(SLOT), 1)

    def item(slot: Column, i: Column) -> Column:
        in_pair = (F.length(slot) > 1) & ends(slot).isin(pairs)
        inner = F.regexp_replace(F.substring(slot, F.lit(2), F.length(slot) - 2), "([\"'])\\1", "$1")
        quoted = F.regexp(slot, F.lit(f"[{_QUOTE_CHARS}]"))
        plain = F.when(quoted, _strip(F.regexp_replace(slot, f"^[{_QUOTE_CHARS}]+|[{_QUOTE_CHARS}]+$", ""))).otherwise(slot)
        stray = F.when(in_pair, F.contains(inner, F.substring(slot, 1, 1))).otherwise(quoted)
        return F.struct((i + 1).alias("pos"), F.when(in_pair, _strip(inner)).otherwise(plain).alias("item"), stray.alias("malformed"))

    return F.filter(F.transform(slots, item), lambda s: s["item"] != "")


def explode_packed(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row for each value packed in ``fields``: ``key, field, pos, item, malformed``.

    Rows of ``df`` that agree in the key and all fields (resends) count once.  A null key is kept.
    An empty table gives no row.  Extra columns are ignored whatever their names.
    """
    each = df.select(F.col(key), *(F.col(f).cast("string").alias(f) for f in fields)).dropDuplicates()
    named = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), split_packed(F.col(f)).alias("items")) for f in fields)))
    return each.select(F.col(key), named.alias("_n")).select(F.col(key), F.col("_n.field").alias("field"), F.inline("_n.items"))
