"""Scoring as DataFrame operators.

Scoring is local to a row: variants of a place and candidates of a query are arrays, scored by one
Arrow UDF call and reduced by array functions, so nothing shuffles and the same plan runs on a
stream. ``score_pairs(distinct=True)`` scores each distinct pair once instead, at the price of a
shuffle of the pairs; it pays where pairs repeat often.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from placelink.functions.text import tier
from placelink.lexicons import DEFAULT, Config
from placelink.operators.scorer import Scorer

_scorers: dict[int, Scorer] = {}
PLACE = "struct<name:string,aliases:array<string>,codes:array<string>>"
DEBUG = """raw_query string, raw_result string, stage1_garbage boolean, quick_exact boolean,
 stage1_normalized struct<query:string,result:string>, stage1_tokens struct<query:array<string>,result:array<string>>,
 stage2_enriched array<string>, stage4_raw double,
 stage4_detail struct<method:string,matched_query_token:string,ratio:double,elevated_quality:boolean,quality:double,substr_position:string,a_contiguous:double,b_ordered_noise:double,b_noise_count:int,c_unordered:double,d_partial:double,d_k_of_m:string,e_fuzzy:double,f_compound:double,best_sub_method:string,after_directional_penalty:double>,
 stage5_adjusted double, penalties_applied array<string>, stage6_final double,
 token_scores array<struct<query_token:string,result_token:string,score:double,method:string>>, final_score double"""


def _scorer(config: Config) -> Scorer:
    key = hash(repr(config))
    if key not in _scorers:
        _scorers[key] = Scorer(config)
    return _scorers[key]


def score_column(query: Column, result: Column, config: Config = DEFAULT) -> Column:
    """Score of a pair; null where either is null."""

    @F.pandas_udf("double")
    def run(q: pd.Series, r: pd.Series) -> pd.Series:
        score = _scorer(config).score
        return pd.Series([None if a is None or b is None else score(a, b) for a, b in zip(q, r)], dtype="float64")

    return run(query, result)


def scores_column(query: Column, results: Column, config: Config = DEFAULT) -> Column:
    """Scores of a query and each string of an array; a null query scores 0."""

    @F.pandas_udf("array<double>")
    def run(q: pd.Series, rs: pd.Series) -> pd.Series:
        score = _scorer(config).score
        return pd.Series([None if r is None else [0.0 if a is None or x is None else score(a, x) for x in r] for a, r in zip(q, rs)])

    return run(query, results)


def evidence_column(query_token: Column, name_token: Column, config: Config = DEFAULT) -> Column:
    """The first rung of the ladder that holds between two tokens: struct of score, method and ratio."""

    @F.pandas_udf("struct<score:double,method:string,ratio:double>")
    def run(q: pd.Series, r: pd.Series) -> pd.DataFrame:
        evidence = _scorer(config).evidence
        return pd.DataFrame([evidence(a, b) for a, b in zip(q, r)], columns=["score", "method", "ratio"])

    return run(query_token, name_token)


def score_pairs(df: DataFrame, query: str = "query", result: str = "result", distinct: bool = False, strict: bool = False, config: Config = DEFAULT) -> DataFrame:
    """``df`` with ``score``. ``strict`` raises on a null; otherwise its score is null."""
    if strict:
        df = df.where(F.assert_true(F.col(query).isNotNull() & F.col(result).isNotNull(), "query and result must be strings").isNull())
    if not distinct:
        return df.withColumn("score", score_column(F.col(query), F.col(result), config))
    pairs = df.select(F.col(query).alias("__q"), F.col(result).alias("__r")).where("__q IS NOT NULL AND __r IS NOT NULL").distinct()
    pairs = pairs.withColumn("score", score_column(F.col("__q"), F.col("__r"), config))
    return df.join(pairs, (F.col(query) == F.col("__q")) & (F.col(result) == F.col("__r")), "left").drop("__q", "__r")


def explain_column(query: Column, result: Column, config: Config = DEFAULT) -> Column:
    """Every stage's outcome as one struct with fixed fields; what a pair does not reach is null."""

    @F.pandas_udf(DEBUG)
    def run(q: pd.Series, r: pd.Series) -> pd.DataFrame:
        scorer = _scorer(config)
        return pd.DataFrame([_breakdown(scorer, a, b) for a, b in zip(q, r)], columns=_FIELDS)

    return run(query, result)


_FIELDS = ["raw_query", "raw_result", "stage1_garbage", "quick_exact", "stage1_normalized", "stage1_tokens", "stage2_enriched", "stage4_raw", "stage4_detail", "stage5_adjusted", "penalties_applied", "stage6_final", "token_scores", "final_score"]
_DETAILS = {"contiguous": "a_contiguous", "ordered": "b_ordered_noise", "unordered": "c_unordered", "partial": "d_partial", "average": "e_fuzzy", "compound": "f_compound"}


def _breakdown(scorer: Scorer, query, result) -> list:
    if query is None or result is None:
        return [query, result, *[None] * 12]
    p = scorer.explain(query, result)
    done = p.raw_score is not None
    detail = dict.fromkeys(["method", "matched_query_token", "ratio", "elevated_quality", "quality", "substr_position", *_DETAILS.values(), "b_noise_count", "d_k_of_m", "best_sub_method", "after_directional_penalty"])
    detail |= {_DETAILS[k]: v for k, v in p.sub_scores.items()}
    renamed = {"noise_count": "b_noise_count", "k_of_m": "d_k_of_m"}
    detail |= {renamed.get(k, k): v for k, v in p.detail.items()}
    scored = [dict(zip(("query_token", "result_token", "score", "method"), t)) for t in p.token_scores]
    return [
        query,
        result,
        p.garbage,
        p.quick_exact,
        dict(zip(("query", "result"), p.normalized)) if p.normalized else None,
        {"query": p.query, "result": p.result} if p.normalized and not p.quick_exact else None,
        p.enriched if done else None,
        p.raw_score,
        detail if done else None,
        p.adjusted,
        p.penalties if done else None,
        p.score if done else None,
        scored,
        p.score,
    ]


def _variants(name, aliases, codes) -> list[str]:
    out: dict[str, str] = {}
    for v in [name, *(() if aliases is None else aliases), *(() if codes is None else codes)] if name else []:
        if v is not None and v.strip():
            out.setdefault(unicodedata.normalize("NFD", v).strip().lower(), v.strip())
    return list(out.values())


@F.pandas_udf(ArrayType(StringType()))
def _variants_column(name: pd.Series, aliases: pd.Series, codes: pd.Series) -> pd.Series:
    return pd.Series([_variants(*x) for x in zip(name, aliases, codes)])


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _variants_of_each(places: pd.Series) -> pd.Series:
    return places.map(lambda ps: [] if ps is None else [[] if p is None else _variants(p["name"], p["aliases"], p["codes"]) for p in ps])


def variants(name: Column, aliases: Column, codes: Column) -> Column:
    """Name, aliases and codes without outer white space, the first of those that differ only in case or
    in how an accent is written; accents themselves tell them apart. Empty where the name is null or empty."""
    return _variants_column(name, aliases, codes)


def _best_first(names: Column, scores: Column) -> Column:
    """(variant, score) entries, the best first, of equal ones in their order; of a repeated variant the first."""
    rows = F.transform(names, lambda v, i: F.struct((-F.coalesce(F.get(scores, i), F.lit(0.0))).alias("minus"), i.alias("i"), v.alias("v")))
    rows = F.filter(rows, lambda x: x["v"].isNotNull() & (F.array_position(names, x["v"]) == x["i"] + 1))
    return F.transform(F.array_sort(rows), lambda x: F.struct(x["v"].alias("key"), F.get(scores, x["i"]).alias("value")))


def with_best_variant(df: DataFrame, query: str = "query", variants_column: str = "variants", config: Config = DEFAULT) -> DataFrame:
    """``df`` with final_score, best_variant (of equal scores the first), variants_total and
    all_scores (variant to score, the best first)."""
    df = df.withColumn("__scores", scores_column(F.col(query), F.col(variants_column), config))
    best = F.array_max("__scores")
    return df.select(
        *[c for c in df.columns if c != "__scores"],
        F.coalesce(best, F.lit(0.0)).alias("final_score"),
        F.try_element_at(F.col(variants_column), F.array_position("__scores", best).cast("int")).alias("best_variant"),
        F.size(variants_column).alias("variants_total"),
        F.map_from_entries(_best_first(F.col(variants_column), F.col("__scores"))).alias("all_scores"),
    )


def score_candidates(df: DataFrame, query: str = "query", candidates: str = "candidates", config: Config = DEFAULT) -> DataFrame:
    """One row per query row and candidate (array of place structs), in the given order: the
    columns of ``df`` but the candidates, then pos, name, and what ``with_best_variant`` adds."""
    rest = [c for c in df.columns if c != candidates]
    rows = df.select(*rest, F.posexplode(candidates).alias("pos", "__place"))
    rows = rows.select(*rest, "pos", F.col("__place.name").alias("name"), variants(F.col("__place.name"), F.col("__place.aliases"), F.col("__place.codes")).alias("variants"))
    return with_best_variant(rows, query, "variants", config)


def best_candidates(df: DataFrame, k: int = 1, query: str = "query", candidates: str = "candidates", config: Config = DEFAULT) -> DataFrame:
    """The k best candidates of each query row, by score and then order, without a shuffle."""
    rest = [c for c in df.columns if c != candidates]
    df = df.withColumn("__variants", _variants_of_each(F.col(candidates))).withColumn("__flat", F.flatten("__variants"))
    df = df.withColumn("__scores", scores_column(F.col(query), F.col("__flat"), config))
    ends = F.aggregate("__variants", F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + F.size(v))))
    df = df.withColumn("__ends", ends)
    ranked = F.transform(
        candidates,
        lambda p, i: F.struct(
            (-F.coalesce(F.array_max(F.slice("__scores", F.get("__ends", i) + 1, F.get("__ends", i + 1) - F.get("__ends", i))), F.lit(0.0))).alias("minus"),
            i.alias("pos"),
            p["name"].alias("name"),
        ),
    )
    top = F.slice(F.array_sort(ranked), 1, k)
    return df.select(*rest, F.posexplode(top).alias("rank", "__top")).select(*rest, (F.col("rank") + 1).alias("rank"), F.col("__top.pos").alias("pos"), F.col("__top.name").alias("name"), (-F.col("__top.minus")).alias("score"))


def with_tier(df: DataFrame, score: str = "final_score", config: Config = DEFAULT) -> DataFrame:
    return df.withColumn("tier", tier(F.col(score), config))
