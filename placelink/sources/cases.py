"""Sources and sinks: test cases, candidate strings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "orc")


def split_flat(flat: Column) -> Column:
    """``"Name, Alias, CODE"`` as its trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(flat, ","), lambda x: F.regexp_replace(x, r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$", "")), lambda x: x != "")


def place_of(flat: Column) -> Column:
    """A place struct of a flat candidate string: the first part names it."""
    parts = split_flat(flat)
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("name"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("aliases"), F.array().cast("array<string>").alias("codes"))


def cases_from(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """In-memory (query, flat candidate) cases with their number from 1."""
    return spark.createDataFrame([(i, q, c) for i, (q, c) in enumerate(pairs, 1)], "sno int, query string, elastic_result string")


def read_cases(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    reader = spark.read.schema("sno int, query string, elastic_result string")
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def write_report(report: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """The report's rows, in a folder for each class of ``by``; a map column becomes JSON in CSV."""
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    if kind == "csv":
        report = report.withColumns({n: F.to_json(n) for n, t in report.dtypes if t.startswith(("map", "array", "struct"))})
    report.write.partitionBy(*by).mode("errorifexists").option("header", True).format(kind).save(path)
