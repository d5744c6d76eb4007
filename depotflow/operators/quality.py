"""Quality rules: many rules on a table become one aggregate, one report row per rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.functions.numbers import rounded

Detail = Callable[[Column, Column], Column]  # (rows checked, rows failed) -> text

PASSING_STATUSES = ("OK", "UP_TO_DATE", "ALREADY_CURRENT", "NO_NEW_DATA")


def text(value: str) -> Detail:
    return lambda checked, failed: F.lit(value)


def sentence(template: str) -> Detail:
    """Template with {failed} and {checked}, printed with thousands separators."""

    def build(checked: Column, failed: Column) -> Column:
        parts = {"checked": grouped(checked), "failed": grouped(failed)}
        pieces = template.replace("{", "\0{").replace("}", "}\0").split("\0")
        return F.concat(*[parts[p[1:-1]] if p.startswith("{") else F.lit(p) for p in pieces if p])

    return build


def grouped(n: Column) -> Column:
    """12345 -> '12,345'."""
    return F.format_number(n.cast("bigint"), 0)


@dataclass(frozen=True)
class RowRule:
    """Counts rows that break a predicate; `applies` limits the rows the rule looks at."""

    name: str
    breaks: Column
    detail: Detail
    level: str = "FAIL"
    applies: Column | None = None


def check_row(name: str, checked: Column, failed: Column, detail: Column, status: Column | None = None, level: str = "FAIL") -> Column:
    """Report row as a struct."""
    if status is None:
        status = F.when(failed == 0, "PASS").otherwise(level)
    return F.struct(
        F.lit(name).alias("check"),
        status.alias("status"),
        checked.cast("bigint").alias("rows_checked"),
        failed.cast("bigint").alias("rows_failed"),
        detail.alias("detail"),
    )


def as_rows(one_row: DataFrame, checks: list[Column]) -> DataFrame:
    """Turn the single row of an aggregate into report rows."""
    return one_row.select(F.inline(F.array(*checks)))


def rule_counts(rules: list[RowRule]) -> list[Column]:
    """Aggregates c0, f0, c1, ...: rows each rule looks at and rows that break it. They add up over parts of a table."""
    aggregates = []
    for i, rule in enumerate(rules):
        applies = F.lit(True) if rule.applies is None else rule.applies
        aggregates += [F.count_if(applies).alias(f"c{i}"), F.count_if(applies & rule.breaks).alias(f"f{i}")]
    return aggregates


def summed_counts(rules: list[RowRule]) -> list[Column]:
    """Aggregates that add the counts of parts."""
    return [F.coalesce(F.sum(f"{x}{i}"), F.lit(0)).alias(f"{x}{i}") for i in range(len(rules)) for x in "cf"]


def rule_rows(counts: DataFrame, rules: list[RowRule]) -> DataFrame:
    checks = []
    for i, rule in enumerate(rules):
        checked, failed = F.col(f"c{i}"), F.col(f"f{i}")
        checks.append(check_row(rule.name, checked, failed, rule.detail(checked, failed), level=rule.level))
    return as_rows(counts, checks)


def run_row_rules(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    """All rules in one pass over `df`."""
    return rule_rows(df.agg(*rule_counts(rules)), rules)


def with_reference_flags(fact: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left-join the distinct keys of each reference: `_found_<column>` is NULL where there is none."""
    for column, (reference, key) in references.items():
        keys = reference.select(F.col(key).alias(f"_ref_{column}")).distinct().withColumn(f"_found_{column}", F.lit(True))
        fact = fact.join(keys, F.col(column) == F.col(f"_ref_{column}"), "left").drop(f"_ref_{column}")
    return fact


def duplicated_groups(df: DataFrame, name: str, keys: list[str], detail: Detail) -> DataFrame:
    """Counts key groups with more than one row."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("c"), F.count_if(F.col("_n") > 1).alias("f")
    )
    return as_rows(totals, [check_row(name, F.col("c"), F.col("f"), detail(F.col("c"), F.col("f")))])


def surplus_rows(df: DataFrame, name: str, key: str) -> DataFrame:
    """Counts rows minus distinct non-NULL keys."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("c"), F.count(F.col(key)).alias("d")
    )
    checked, distinct = F.col("c"), F.col("d")
    detail = F.concat(
        F.lit("total="), grouped(checked), F.lit(", distinct="), grouped(distinct), F.lit(", duplicates="), grouped(checked - distinct)
    )
    return as_rows(totals, [check_row(name, checked, checked - distinct, detail)])


def same_row_count(name: str, source: DataFrame, loaded: Column) -> DataFrame:
    """Compares the row count of a source with the number of rows loaded."""
    both = source.agg(F.count(F.lit(1)).alias("s")).withColumn("l", loaded)
    detail = F.concat(F.lit("source="), grouped(F.col("s")), F.lit(", loaded="), grouped(F.col("l")))
    return as_rows(both, [check_row(name, F.col("s"), F.abs(F.col("l") - F.col("s")), detail)])


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_failure_pct(checks: DataFrame) -> DataFrame:
    """Report layout of the star schema: check_name and failure_pct."""
    share = F.when(F.col("rows_checked") > 0, F.col("rows_failed") / F.col("rows_checked") * 100).otherwise(0.0)
    return checks.select(
        F.col("check").alias("check_name"), "status", "rows_checked", "rows_failed", rounded(share, 4).alias("failure_pct"), "detail"
    )
