"""Number and text coercion rules that every operator shares.

Raw request values are loosely typed: a number may arrive as text, as null or not at all. The
helpers below give one meaning to each case, as Catalyst expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the blanks that a trim removes.
BLANK = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

_DECIMAL = rf"^{BLANK}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?){BLANK}*$"
_HEX = rf"^{BLANK}*0[xX]([0-9a-fA-F]+){BLANK}*$"


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves toward +infinity, as BIGINT."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def round_digits(x: Column, digits: int) -> Column:
    """`round_half_up` to a number of decimals, as DOUBLE."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def or_default(x: Column, default) -> Column:
    """`default` where `x` is missing, zero or NaN."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(x.isNull() | (x == 0) | F.isnan(x.cast("double")), default).otherwise(x)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def trim_blanks(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def non_empty(x: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(x, F.lit(""))


def leading_int(x: Column) -> Column:
    """The whole number a text starts with, as DOUBLE; null where it starts with none."""
    return F.regexp_extract(x, f"^{BLANK}*([+-]?[0-9]+)", 1).try_cast("double")


def to_number(x: Column) -> Column:
    """The number a text spells, as DOUBLE: null and blank text are 0, any other text is null. A plain
    decimal is found with one pattern; the other forms are looked at only where it does not match."""
    decimal = F.regexp_extract(x, _DECIMAL, 1).try_cast("double")
    special = F.when(x.isNull() | x.rlike(f"^{BLANK}*$"), F.lit(0.0)).when(
        x.rlike(_HEX), F.conv(F.regexp_extract(x, _HEX, 1), 16, 10).try_cast("double")
    )
    return F.coalesce(decimal, special)


def int_param(raw: Column, default: int, low: int, high: int) -> Column:
    """A whole-number request parameter: leading digits, default when missing or 0, then bounds."""
    return clamp(or_default(leading_int(raw), float(default)), float(low), float(high)).cast("bigint")


def instant_of(wall_time: Column) -> Column:
    """The instant of a UTC wall time, whatever zone the session has. Instants pass through unchanged."""
    return F.expr("timestamp'1970-01-01 00:00:00Z'") + (wall_time - F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def utc_wall_time(instant: Column) -> Column:
    """The UTC wall time of an instant, whatever zone the session has."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + (instant - F.expr("timestamp'1970-01-01 00:00:00Z'"))


def utf16_length(x: Column) -> Column:
    """Text length in UTF-16 units."""
    return (F.length(F.encode(x, "UTF-16BE")) / 2).cast("bigint")


def utf16_prefix(x: Column, units: int) -> Column:
    """The first `units` UTF-16 units of a text; a character that would be cut in two is left out."""
    plain = F.substring(x, 1, units)
    raw = F.encode(plain, "UTF-16BE")
    half = F.hex(F.substring(raw, 2 * units - 1, 1)).between("D8", "DB")
    cut = F.decode(F.substring(raw, F.lit(1), F.when(half, F.lit(2 * units - 2)).otherwise(F.lit(2 * units))), "UTF-16BE")
    return F.when(plain.rlike(r"[\x{10000}-\x{10FFFF}]"), cut).otherwise(plain)
