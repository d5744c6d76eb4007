"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AMOUNT = "decimal(18,4)"  # one transaction
TOTAL = "decimal(28,4)"  # an amount that already sums many transactions
EXACT_DOUBLES = float(2**53)  # from here on a double has no digits after the point


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(x: Column | str) -> Column:
    """Number from text; text that is no number becomes NULL."""
    return _col(x).try_cast("double")


def to_whole(x: Column | str, default: int | None = None) -> Column:
    """Whole number, cut towards zero; unreadable text becomes `default`, or NULL when there is none."""
    value = to_double(x).try_cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole where whole > 0, else NULL."""
    part, whole = _col(part), _col(whole)
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def rounded(x: Column | str, digits: int) -> Column:
    """Round half away from zero on the binary value, as the C library does (1.005 gives 1.0)."""
    x, scale = _col(x), float(10**digits)
    scaled = F.abs(x) * F.lit(scale)
    shifted = F.floor(scaled + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(scaled >= EXACT_DOUBLES, x).when(x < 0, -shifted).otherwise(shifted)


def percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """Rounded 100 * part / whole, NULL when whole is 0."""
    return rounded(F.try_divide(F.lit(100.0) * _col(part), _col(whole).cast("double")), digits)


def not_below_zero(x: Column | str) -> Column:
    """Negative values become 0, NULL stays NULL (greatest() would turn NULL into 0)."""
    x = _col(x)
    return F.when(x < 0, F.lit(0)).otherwise(x)


def exact(x: Column | str, kind: str = AMOUNT) -> Column:
    """Fixed-point form of an amount: its sums do not depend on the order of the rows."""
    return _col(x).cast(kind)


def exact_sum(x: Column | str, kind: str = AMOUNT) -> Column:
    """Order-independent sum of amounts, as double."""
    return F.sum(exact(x, kind)).cast("double")


def exact_mean(x: Column | str, kind: str = AMOUNT) -> Column:
    """Order-independent mean of amounts, as double; NULL for no rows."""
    return F.try_divide(exact_sum(x, kind), F.count(_col(x)).cast("double"))
