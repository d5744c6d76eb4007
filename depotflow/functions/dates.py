"""Date column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_date(x: Column | str) -> Column:
    """Date from ISO text; unreadable text fails the job."""
    return F.to_date(_col(x))


def lenient_date(x: Column | str) -> Column:
    """Date from ISO text; unreadable text becomes NULL."""
    return _col(x).try_cast("date")


def date_key(d: Column | str) -> Column:
    """20231231 for 2023-12-31."""
    d = _col(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def season(month: Column) -> Column:
    """Season of the northern hemisphere."""
    return (
        F.when(month.between(3, 5), "Spring")
        .when(month.between(6, 8), "Summer")
        .when(month.between(9, 11), "Autumn")
        .otherwise("Winter")
    )


def quarter_label(d: Column | str) -> Column:
    """'2023-Q4'."""
    d = _col(d)
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def month_of(d: Column | str) -> Column:
    return F.trunc(_col(d), "MM")


def calendar_columns(d: Column | str) -> dict[str, Column]:
    """Attributes of a day, as the date dimension stores them (Monday is day 1)."""
    d = _col(d)
    weekday = F.weekday(d)
    return {
        "date_key": date_key(d),
        "full_date": d,
        "day_of_week": weekday + 1,
        "day_name": F.date_format(d, "EEEE"),
        "day_of_month": F.dayofmonth(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "month_num": F.month(d),
        "month_name": F.date_format(d, "MMMM"),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "is_weekend": weekday >= 5,
        "is_month_start": F.dayofmonth(d) == 1,
        "is_month_end": d == F.last_day(d),
        "is_quarter_end": (d == F.last_day(d)) & (F.month(d) % 3 == 0),
        "season": season(F.month(d)),
    }


def calendar_features(d: Column | str) -> dict[str, Column]:
    """Calendar part of the feature store (Monday is day 0)."""
    d = _col(d)
    return {
        "day_of_week": F.weekday(d),
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "is_weekend": F.weekday(d) >= 5,
        "season": season(F.month(d)),
    }
