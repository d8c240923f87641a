"""Arithmetic and mathematical functions with MySQL meaning: errors of domain give NULL, never NaN or an exception."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """`/`: always fractional, NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def divide_decimal(a: Column, b: Column, scale: int) -> Column:
    """`/` of decimals: the dividend's scale and four digits more."""
    return F.round(F.try_divide(a, b), scale + 4).cast(f"decimal(38,{scale + 4})")


def int_divide(a: Column, b: Column) -> Column:
    """DIV: the quotient cut toward zero, NULL for a zero divisor."""
    multiple = a - F.try_mod(a, b)  # exact, so that the quotient isn't rounded up
    return F.round(F.try_divide(multiple.cast("decimal(38,10)"), b.cast("decimal(38,10)"))).cast("long")


def modulo(a: Column, b: Column) -> Column:
    """`%` and MOD: the dividend's sign, NULL for a zero divisor."""
    return F.try_mod(a, b)


def truncate(x: Column, digits: int) -> Column:
    """TRUNCATE: toward zero; negative digits cut before the point."""
    d = x.cast("decimal(30,10)")
    shift = F.lit(Decimal(10 ** abs(digits)))
    if digits >= 0:
        return (F.sign(d) * F.floor(F.abs(d) * shift) / shift).cast("double")
    return (F.sign(d) * F.floor(F.abs(d) / shift) * shift).cast("double")


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log(base: Column, x: Column) -> Column:
    """LOG(b, x): NULL for b <= 0, b = 1 and x <= 0."""
    return F.when((base > 0) & (base != 1) & (x > 0), F.ln(x) / F.ln(base))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def acos(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.acos(x))


def asin(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.asin(x))


def cot(x: Column) -> Column:
    return F.when(F.sin(x) != 0, F.cot(x))


def unsigned(x: Column) -> Column:
    """A signed 64-bit number read as unsigned."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit(Decimal(2**64))).otherwise(d)


def bit_not(x: Column) -> Column:
    return unsigned(F.bitwise_not(x.cast("long")))


def shift_left(x: Column, n: int) -> Column:
    return unsigned(F.shiftleft(x.cast("long"), n)) if n < 64 else F.when(x.isNotNull(), F.lit(0).cast("decimal(20,0)"))


def shift_right(x: Column, n: int) -> Column:
    return unsigned(F.shiftrightunsigned(x.cast("long"), n)) if n < 64 else F.when(x.isNotNull(), F.lit(0).cast("decimal(20,0)"))


def leading_number(s: Column) -> Column:
    """What a string counts as in arithmetic: the number at its start, else 0."""
    found = F.regexp_extract(s, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(s.isNull(), None).when(found == "", F.lit(0.0)).otherwise(found.try_cast("double"))


def cast_signed(s: Column) -> Column:
    """CAST(string AS SIGNED): the whole number at its start, else 0."""
    found = F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(s.isNull(), None).when(found == "", F.lit(0).cast("long")).otherwise(found.try_cast("long"))


def xor(a: Column, b: Column) -> Column:
    """Three-valued exclusive or of conditions."""
    return a != b


def bit_and_agg(x: Column) -> Column:
    """BIT_AND over a group: all ones without a value."""
    return F.coalesce(unsigned(F.bit_and(x)), F.lit(Decimal(2**64 - 1)))


def bit_or_agg(x: Column) -> Column:
    return F.coalesce(unsigned(F.bit_or(x)), F.lit(0).cast("decimal(20,0)"))


def bit_xor_agg(x: Column) -> Column:
    return F.coalesce(unsigned(F.bit_xor(x)), F.lit(0).cast("decimal(20,0)"))
