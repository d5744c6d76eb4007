"""Text column expressions and column naming."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Spellings of the two truth values, and texts that stand for a missing value.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
MISSING_WORDS = ("nan", "None", "")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def snake(name: str) -> str:
    """'OTIFRate' -> 'otif_rate', 'OnHand-Qty' -> 'on_hand_qty'."""
    spaced = re.sub(r"(?<=[a-z\d])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return re.sub(r"[ -]", "_", spaced.strip()).lower()


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def to_boolean(x: Column | str) -> Column:
    """Truth value from its usual spellings; anything else is NULL."""
    word = F.lower(F.trim(_col(x).cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def missing_to_null(x: Column | str) -> Column:
    x = _col(x)
    return F.when(~x.isin(*MISSING_WORDS), x)


def anonymous_id(x: Column | str) -> Column:
    """'OP-' and the first 8 hex digits of the SHA-256, upper case."""
    return F.concat(F.lit("OP-"), F.upper(F.substring(F.sha2(_col(x), 256), 1, 8)))


def bucket_of(x: Column, buckets: Column) -> Column:
    """Stable bucket number from the first 7 hex digits of the MD5."""
    number = F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("bigint")
    return F.pmod(number, buckets.cast("bigint")).cast("int")
