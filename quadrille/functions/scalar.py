"""Scalar functions and operators as columns (FN1-FN13, EV6-EV12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column, digits: int = 0) -> Column:
    """FN5, in binary arithmetic: 1.005 to 2 digits is 1.0."""
    m = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * m + 0.5).cast("double") / m


def round_down(x: Column, digits: int = 0) -> Column:
    m = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * m).cast("double") / m


def exp(x: Column) -> Column:
    return F.exp(x)


def pmt(rate: Column, n: Column, pv: Column, fv: Column | float = 0.0, at_start: bool = False) -> Column:
    """FN8: the payment of an annuity."""
    fv = fv if isinstance(fv, Column) else F.lit(float(fv))
    growth = F.pow(1 + rate, n)
    annuity = -(pv * growth + fv) * rate / (growth - 1)
    flat = -(pv + fv) / n
    return F.when(rate == 0, flat).otherwise(annuity / (1 + rate) if at_start else annuity)


def number_text(x: Column) -> Column:
    """Numbers without a fraction print as integers."""
    return F.when(x == x.cast("long"), x.cast("long").cast("string")).otherwise(x.cast("string"))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def concatenate(*parts: Column) -> Column:
    """FN9: null parts are empty; white space is normalised."""
    return normalised(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))


def divide(a: Column, b: Column) -> tuple[Column, Column]:
    """EV7: value and error."""
    return F.try_divide(a, b), F.when(b == 0, "DIV/0!")


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    """FN1: only TRUE is true."""
    return F.when(condition, then).otherwise(otherwise)


def is_blank(vtype: Column) -> Column:
    return vtype.isNull() | (vtype == "no_type")


def is_error(err: Column) -> Column:
    return err.isNotNull()


def first_error(*errors: Column) -> Column:
    return F.coalesce(*errors)


def percent(x: Column) -> Column:
    return x / 100.0


def same_values(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """VF2: equal, or relatively close."""
    return F.coalesce((a == b) | (F.abs(F.try_divide(a, b) - 1) < tolerance), F.lit(False)) | (a.isNull() & b.isNull())
