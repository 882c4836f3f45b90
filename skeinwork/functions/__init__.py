"""Column functions that the operators share; all are built from Spark's own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text of an unreached vertex in files.
UNREACHED = "INF"


def number(text: Column) -> Column:
    """A number, or null for null, empty or malformed text."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def parse_id(text: Column, base: str = "auto") -> Column:
    """A vertex id from text in base 10, 16 or, for ``auto``, 16 with a 0x prefix or a letter a-f and 10 else; malformed text raises."""
    t = F.lower(F.trim(text))
    bare = F.regexp_replace(t, "^0x", "")
    as_hex = F.when(bare.rlike("^[0-9a-f]{1,15}$"), F.conv(bare, 16, 10).cast("bigint"))
    as_dec = F.when(t.rlike("^[0-9]{1,18}$"), t.try_cast("bigint"))
    if base == "auto":
        value = F.when(t.rlike("^0x|[a-f]"), as_hex).otherwise(as_dec)
    elif base in ("10", "16"):
        value = as_dec if base == "10" else as_hex
    else:
        raise ValueError(f"unknown base: {base}")
    return F.when(text.isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce(value, F.raise_error(F.concat(F.lit("invalid id: "), text)).cast("bigint")))


def integer_literal(text: Column) -> Column:
    """A signed integer in decimal, 0x, 0o or 0b notation (a leading zero alone is not allowed); null if malformed."""
    t = F.lower(text)
    sign = F.when(t.startswith("-"), -1).otherwise(1)
    bare = F.regexp_replace(t, "^[+-]", "")
    digits = F.substring(bare, 3, 64)
    value = (
        F.when(bare.rlike("^0x[0-9a-f]{1,15}$"), F.conv(digits, 16, 10).cast("bigint"))
        .when(bare.rlike("^0o[0-7]{1,20}$"), F.conv(digits, 8, 10).cast("bigint"))
        .when(bare.rlike("^0b[01]{1,62}$"), F.conv(digits, 2, 10).cast("bigint"))
        .when(bare.rlike("^(0+|[1-9][0-9]{0,17})$"), bare.try_cast("bigint"))
    )
    return sign * value


def hex_edge(src: Column, dst: Column) -> Column:
    return F.concat_ws(" -> ", F.lower(F.hex(src)), F.lower(F.hex(dst)))


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / F.lit(b)).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if one of them is null or b is 0."""
    return F.when(b != 0, a / b)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match with line anchors, or ""; only a line feed ends a line."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), f"(?md){pattern}", group)


def delta_text(before: Column, after: Column) -> Column:
    """after - before of numeric text: "" if one isn't a number, an integer if integral, else three decimals."""
    d = number(after) - number(before)
    return F.when(d.isNull(), "").when(d == F.floor(d), d.cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.3f", d))


def six_digits(x: float | None) -> str:
    """Report form of a number: at most six significant digits, no trailing zeros; "" for none."""
    return "" if x is None else f"{x:.6g}"


def tokens_to_map(line: Column) -> Column:
    """Map of the k=v words of a line; the last of equal keys counts, words without = are left out."""
    words = F.reverse(F.filter(F.split(F.trim(line), r"\s+"), lambda w: w.contains("=")))
    keys = F.transform(words, lambda w: F.substring_index(w, "=", 1))

    def entries(b: Column) -> Column:
        pairs = F.transform(b["words"], lambda w, i: F.struct(F.get(b["keys"], i).alias("k"), F.substr(w, F.length(F.get(b["keys"], i)) + 2).alias("v")))
        # reversed, so the first of equal keys is the last of the line
        return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(b["keys"], x["k"]) == i + 1))

    # words and keys are worked out once, as the argument of a lambda
    return F.transform(F.array(F.struct(words.alias("words"), keys.alias("keys"))), entries)[0]


def token(line: Column, key: str) -> Column:
    """Value of the last word key=... of a line, or null: for a few known keys, without the map."""
    mine = rf"(?s)^(?:.*\s)?{re.escape(key)}=(\S*)"
    return F.when(line.rlike(mine), F.regexp_extract(line, mine, 1))
