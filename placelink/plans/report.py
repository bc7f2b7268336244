"""Report over cases: score, tier, all variants, the stages passed, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelink.lexicons import DEFAULT, Config
from placelink.operators.pairs import explain_column, variants, with_best_variant, with_tier
from placelink.sources.cases import place_of


def report(cases: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """sno, query, elastic_result, final_score, best_variant, variants_total, all_scores, pipeline, tier."""
    place = cases.withColumn("__p", place_of(F.col("elastic_result")))
    rows = place.withColumn("variants", variants(F.col("__p.name"), F.col("__p.aliases"), F.col("__p.codes"))).drop("__p")
    rows = with_best_variant(rows, "query", "variants", config).withColumn("__d", explain_column(F.col("query"), F.col("best_variant"), config))
    passed = F.concat_ws(
        " > ",
        F.when(F.col("__d.stage1_garbage"), "garbage"),
        F.when(F.col("__d.quick_exact"), "exact"),
        F.concat(F.lit("tokens "), F.concat_ws(" ", "__d.stage1_tokens.query"), F.lit(" | "), F.concat_ws(" ", "__d.stage1_tokens.result")),
        F.concat(F.lit("raw "), F.coalesce("__d.stage4_detail.method", "__d.stage4_detail.best_sub_method"), F.format_string(" %.4f", "__d.stage4_raw")),
        F.when(F.size("__d.penalties_applied") > 0, F.array_join("__d.penalties_applied", " > ")),
        F.format_string("final %.4f", "final_score"),
    )
    return with_tier(rows.withColumn("pipeline", passed).drop("__d", "variants"), "final_score", config)


def summary(scored: DataFrame, score: str = "final_score", config: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """total, high, medium, low, avg, min and max in one row, or in one for each class of ``by``; combined
    before the shuffle."""
    s = F.col(score)
    return scored.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(s >= config.high).alias("high"),
        F.count_if((s >= config.medium) & (s < config.high)).alias("medium"),
        F.count_if(s < config.medium).alias("low"),
        F.avg(s).alias("avg"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
    )


def trace(scored: DataFrame) -> DataFrame:
    """One JSON line for each row's breakdown column ``debug``."""
    return scored.select(F.to_json("debug").alias("trace"))


def trace_text(scored: DataFrame) -> DataFrame:
    """The same breakdown to read: a line for each stage that the pair reached."""
    d = lambda path: F.col(f"debug.{path}")
    words = lambda path: F.concat_ws(" ", d(path))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name:<10}"), value))
    number = lambda path: F.when(d(path).isNotNull(), F.format_string("%.4f", d(path)))
    full = d("stage4_raw").isNotNull()
    token = F.transform(d("token_scores"), lambda t: F.format_string("          %s ~ %s: %.4f %s", t["query_token"], t["result_token"], t["score"], t["method"]))
    lines = [
        line("query", d("raw_query")),
        line("result", d("raw_result")),
        F.when(d("stage1_garbage"), "garbage"),
        F.when(d("quick_exact"), "equal after folding"),
        line("tokens", F.when(d("stage1_tokens").isNotNull(), F.concat(words("stage1_tokens.query"), F.lit(" | "), words("stage1_tokens.result")))),
        line("enriched", F.when(full, words("stage2_enriched"))),
        F.when(full & (F.size(token) > 0), F.array_join(token, "\n")),
        line("raw", F.when(full, F.concat(number("stage4_raw"), F.lit(" "), F.coalesce(d("stage4_detail.method"), d("stage4_detail.best_sub_method"))))),
        F.when(F.size(d("penalties_applied")) > 0, F.array_join(F.transform(d("penalties_applied"), lambda x: F.concat(F.lit("penalty   "), x)), "\n")),
        line("final", number("final_score")),
    ]
    return scored.select(F.concat_ws("\n", *lines).alias("trace"))
