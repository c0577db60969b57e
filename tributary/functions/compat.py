"""Column helpers for the semantics in which the reference engine differs from ANSI SQL.

Defaults everywhere else are standard SQL; these are for callers that want the older results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; a zero divisor is an error. The remainder is taken off first, so no quotient is rounded."""
    a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    return ((a - a % b) / b).cast("long")


def float_div(a: Column, b: Column) -> Column:
    """Double division; anything by zero is plus infinity."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.lit(float("inf"))).otherwise(a / F.when(b != 0, b))


def case_zero(*branches: tuple[Column, Column]) -> Column:
    """A searched CASE whose missing ELSE is 0."""
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out.otherwise(F.lit(0))


def sum_double(x: Column) -> Column:
    """SUM over doubles, whatever the numeric type."""
    return F.sum(x.cast("double"))


def sum0(x: Column) -> Column:
    return F.coalesce(sum_double(x), F.lit(0.0))


def avg0(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def min0(x: Column) -> Column:
    return F.coalesce(F.min(x), F.lit(0))


def max0(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(0))


def as_flag(condition: Column) -> Column:
    """A predicate as the integers 0 and 1."""
    return condition.cast("int")


def decimal_text(x: Column) -> Column:
    """Two decimals with trailing zeros taken off, one digit kept after the point."""
    return F.regexp_replace(F.format_string("%.2f", x), r"(\.\d)0$", "$1")


def csv_field(x: Column) -> Column:
    """A string as an RFC 4180 field."""
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
