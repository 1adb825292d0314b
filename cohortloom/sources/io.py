"""Typed scans, sinks and column naming (parquet and CSV only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scan_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None):
    """Parquet scan; the schema is declared where the caller knows it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row and a declared schema (no inference pass over the data)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV folder with headers and no row names; many part files, never one task."""
    df.write.mode(mode).option("header", True).csv(path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise an intermediate table and continue from the written copy."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_names(df: DataFrame) -> DataFrame:
    names = [c.lower() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names collide once lower-cased")
    return df.toDF(*names)


def rename_by_role(
    df: DataFrame, columns: list[str], prefix: str = "", suffix: str = ""
) -> DataFrame:
    """Add a role prefix or suffix to the listed columns, by name."""
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in columns})
