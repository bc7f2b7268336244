"""Command line: ``python -m placelink report CASES OUT`` and ``python -m placelink explain QUERY NAME``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from placelink.operators.pairs import explain_column
from placelink.plans.report import report, summary, trace_text
from placelink.sources.cases import FORMATS, read_cases, write_report


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="placelink")
    tasks = parser.add_subparsers(dest="task", required=True)
    run = tasks.add_parser("report", help="score a table of cases (sno, query, elastic_result) and write the report")
    run.add_argument("cases")
    run.add_argument("out")
    run.add_argument("--kind", choices=FORMATS, default="parquet", help="format of the cases")
    run.add_argument("--out-kind", choices=FORMATS, default="parquet")
    run.add_argument("--by-tier", action="store_true", help="a folder for each tier")
    one = tasks.add_parser("explain", help="score one pair and show every stage")
    one.add_argument("query")
    one.add_argument("name")
    chosen = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("placelink").getOrCreate()
    if chosen.task == "explain":
        pair = spark.createDataFrame([(chosen.query, chosen.name)], "query string, name string")
        print(trace_text(pair.select(explain_column(F.col("query"), F.col("name")).alias("debug"))).first().trace)
        return
    rows = report(read_cases(spark, chosen.cases, chosen.kind))
    write_report(rows, chosen.out, chosen.out_kind, ("tier",) if chosen.by_tier else ())
    print(summary(spark.read.format(chosen.out_kind).option("header", True).option("inferSchema", True).load(chosen.out)).first().asDict())


if __name__ == "__main__":
    main()
