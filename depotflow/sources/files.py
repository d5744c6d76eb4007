"""CSV sources with a contract check, and the CSV export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class ContractError(ValueError):
    """One or more source files are missing, empty or lack required columns."""


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line; only that line is read."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def contract_errors(spark: SparkSession, path: str, required: list[str]) -> list[str]:
    try:
        header = header_of(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return [f"{path}: file not found"]
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return [f"{path}: file is empty"]
        raise
    if not header:
        return [f"{path}: file is empty"]
    missing = sorted(set(required) - set(header))
    return [f"{path}: missing columns {missing}"] if missing else []


def check_contracts(spark: SparkSession, folder: str, required: dict[str, list[str]]) -> None:
    """Check all files before any is loaded; raise one error that names every problem."""
    errors = [e for name, cols in required.items() for e in contract_errors(spark, f"{folder}/{name}", cols)]
    if errors:
        raise ContractError("; ".join(errors))


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, so that casting rules are explicit; optionally only some columns."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_all(spark: SparkSession, folder: str, required: dict[str, list[str]]) -> dict[str, DataFrame]:
    check_contracts(spark, folder, required)
    return {name.removesuffix(".csv"): read_csv(spark, f"{folder}/{name}") for name in required}


def export_csv(df: DataFrame, path: str, order_by: list[Column | str] | None = None) -> None:
    """CSV files with header; sorted across files when an order is given."""
    (df.orderBy(*order_by) if order_by else df).write.mode("overwrite").option("header", True).csv(path)


def with_audit(df: DataFrame, loaded_at: Column, source: str) -> DataFrame:
    return df.withColumns({"etl_loaded_at": loaded_at, "etl_source_file": F.lit(source)})


def with_optional(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Add a NULL column when the source does not deliver it."""
    return df if column in df.columns else df.withColumn(column, F.lit(None).cast(kind))
