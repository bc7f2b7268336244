"""Queries over the driver's tables with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelink.functions import kernels, text
from placelink.lexicons import DEFAULT
from placelink.operators import candidates, pairs
from placelink.plans import oracle, report
from placelink.sources.cases import split_flat

TYPOS = {
    0: "{r}",
    1: "lower({r})",
    2: "concat(substr({r}, 1, 2), substr({r}, 4))",
    3: "concat(substr({r}, 1, 2), substr({r}, 2))",
    4: "concat(substr({r}, 2, 1), substr({r}, 1, 1), substr({r}, 3))",
    5: "concat('X', {r})",
    6: "concat({r}, 'n')",
    7: "concat('New ', {r}, ' Street')",
}
TYPO_SQL = "CASE s_suppkey % 8 " + " ".join(f"WHEN {k} THEN {v.format(r='r_name')}" for k, v in TYPOS.items()) + " END"
#: What the short names below stand for.
MEANT = ["california", "canada", "india", "northwest", "states", "united"]
SHORT_SQL = "CASE s_suppkey % 5 WHEN 0 THEN 'USA' WHEN 1 THEN 'Bharat' WHEN 2 THEN 'NW' WHEN 3 THEN 'ca' ELSE 'Old Town' END"
ADDRESS_SQL = f"concat('Unit ', CAST(s_suppkey AS {{text}}), ', ', n_name, ', ', {SHORT_SQL}, ', ', {TYPO_SQL})"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address for each supplier, with the region it means."""
    s, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows at any scale
    rows = s.join(F.broadcast(places), s.s_nationkey == n.n_nationkey)
    return rows.select("s_suppkey", "r_name", F.expr(ADDRESS_SQL.format(text="STRING")).alias("query"), F.expr(TYPO_SQL).alias("typed"))


_ADDR = f"""addr AS (SELECT s_suppkey, r_name, {ADDRESS_SQL.format(text="VARCHAR")} AS query, {TYPO_SQL} AS typed
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


_CANDIDATES = f"""{_ADDR}, names AS (SELECT r_name AS name, (row_number() OVER (ORDER BY r_regionkey) - 1)::INTEGER AS pos FROM region),
cand AS (SELECT s_suppkey, query, r_name, name, pos, s_suppkey * 100 + pos AS id FROM addr, names)"""
_CANDIDATE_SRC = "src AS (SELECT id, query, name AS result FROM cand)"


def with_regions(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Each row with the five regions, a table of fixed size, as candidates."""
    names = [r.r_name for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]
    places = F.array(*[F.struct(F.lit(x).alias("name"), F.array(F.lit(x.title())).alias("aliases"), F.array().cast("array<string>").alias("codes")) for x in names])
    return rows.withColumn("candidates", places)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best region of each supplier's address, with tier."""
    rows = with_regions(spark, sf_dir, addresses(spark, sf_dir))
    return pairs.with_tier(pairs.best_candidates(rows).select("s_suppkey", "query", "r_name", "name", "score"), "score")


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_regions(spark, sf_dir, addresses(spark, sf_dir))
    return pairs.score_candidates(rows).select("s_suppkey", "pos", "name", "final_score", "best_variant", "variants_total", F.to_json("all_scores").alias("all_scores"))


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = addresses(spark, sf_dir)
    return rows.select("s_suppkey", F.to_json(pairs.explain_column(F.col("query"), F.col("r_name"))).alias("trace"))


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = addresses(spark, sf_dir).select(F.col("s_suppkey").cast("int").alias("sno"), "query", F.concat(F.initcap("r_name"), F.lit(", "), F.lower("r_name"), F.lit(", region")).alias("elastic_result"))
    return report.report(rows).withColumn("all_scores", F.to_json("all_scores"))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.summary(pairs.score_pairs(addresses(spark, sf_dir).withColumnRenamed("r_name", "result"), distinct=True), "score")
    return out.withColumn("avg", F.round("avg", 6))


def summary_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary for each class, here the region meant."""
    scored = pairs.score_pairs(addresses(spark, sf_dir).withColumn("result", F.col("r_name")), distinct=True)
    return report.summary(scored, "score", by=("r_name",)).withColumn("avg", F.round("avg", 6))


def place_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best places for each address, found among all regions and nations by the token index."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    name = lambda c: [F.col(c).alias("name"), F.array(F.initcap(c)).alias("aliases"), F.array().cast("array<string>").alias("codes")]
    places = n.select(F.col("n_nationkey").cast("long").alias("place_id"), *name("n_name")).union(r.select((F.col("r_regionkey") + 100).cast("long").alias("place_id"), *name("r_name")))
    found = candidates.match_places(addresses(spark, sf_dir).select("s_suppkey", "query"), places, 3)
    return found.select("s_suppkey", F.col("rank").cast("long").alias("rank"), "place_id", "name", "score")


def flat_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.concat("p_name", F.lit(" , "), "p_brand", F.lit(",, "), "p_type")
    parts = split_flat(flat)
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select("p_partkey", F.try_element_at(parts, F.lit(1)).alias("name"), F.array_join(F.slice(parts, 2, F.size(parts) - 1), "|").alias("aliases"))


def garbage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    flag = lambda x: F.coalesce(text.is_garbage(x), F.lit(True))
    known = F.expr("CASE turn % 3 WHEN 0 THEN ' N/A 123' WHEN 1 THEN '--' ELSE '42 7' END")
    return df.select("conv_id", "turn", flag(F.col("text")).alias("garbage"), flag(known).alias("known_garbage"), flag(F.split(F.col("text"), " ")[0]).alias("first_word_garbage"))


def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = text.with_normalized(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "folded")
    return df.select("doc_id", F.md5(F.col("folded").cast("binary")).alias("folded_md5"))


def address_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = addresses(spark, sf_dir)
    clean = text.cleaned(text.normalized(F.col("query")))
    raw, name = text.tokens(clean, True), text.tokens(text.cleaned(text.normalized(F.col("r_name"))), False)
    q = text.query_tokens(raw, name)
    return df.select(
        "s_suppkey",
        F.size(F.split(clean, " ")).cast("long").alias("n_words"),
        F.array_join(q, " ").alias("query_tokens"),
        F.array_join(text.result_tokens(name), " ").alias("result_tokens"),
        F.array_join(text.enriched(q), " ").alias("enriched"),
    )


def typo_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs, each compared once."""
    df = addresses(spark, sf_dir).select(F.lower("typed").alias("q"), F.lower("r_name").alias("r")).distinct()
    return df.select("q", "r", F.levenshtein("q", "r").cast("long").alias("edits"), F.round(kernels.jaro_winkler_column(F.col("q"), F.col("r")), 6).alias("jw"))


def token_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence between each word of an address, or what it stands for, and each word of a
    region's name: every rung of the ladder, each distinct pair of words once."""
    words = [w for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect() for w in r.r_name.lower().split()] + MEANT
    typed = F.split(F.lower(F.concat_ws(" ", "typed", F.expr(SHORT_SQL), F.concat("r_name", F.lit("s")), F.expr("substr(r_name, 2)"), F.expr("substr(r_name, 3, 4)"), F.concat(F.lit("xy"), "r_name", F.lit("zw")))), " ")
    df = addresses(spark, sf_dir).select(F.explode(typed).alias("q")).where("q <> ''").distinct()
    df = df.withColumn("r", F.explode(F.array(*map(F.lit, words)))).withColumn("e", pairs.evidence_column(F.col("q"), F.col("r")))
    return df.select("q", "r", "e.method", F.round("e.score", 6).alias("score"), "e.ratio")


def best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arg-max over candidates by edits, ties to the first name."""
    regions = [r.r_name for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_name").collect()]
    ranked = F.array_sort(F.array(*[F.struct(F.levenshtein(F.upper("typed"), F.lit(x)).alias("edits"), F.lit(x).alias("best")) for x in regions]))
    return addresses(spark, sf_dir).select("s_suppkey", F.get(ranked, 0).alias("b")).select("s_suppkey", "b.best", F.col("b.edits").cast("long").alias("edits"))


def edit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = addresses(spark, sf_dir).withColumn("score", F.round(1 - F.levenshtein(F.upper("typed"), F.col("r_name")) / 10, 4))
    return df.groupBy(text.tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def top_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three addresses of each region that are nearest to it: a bounded report."""
    from pyspark.sql import Window

    df = addresses(spark, sf_dir).withColumn("edits", F.levenshtein(F.upper("typed"), F.col("r_name")).cast("long"))
    rank = F.row_number().over(Window.partitionBy("r_name").orderBy("edits", "s_suppkey"))
    return df.withColumn("place", rank).where("place <= 3").select("r_name", F.col("place").cast("long").alias("place"), "s_suppkey", "edits")


def phonetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernels.register(spark)
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return words.selectExpr("word", "soundex_cp(word) AS soundex", "metaphone(word) AS metaphone", "porter_stem(word) AS stem")


def distinct_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = addresses(spark, sf_dir).select("s_suppkey", F.col("typed").alias("query"), F.col("r_name").alias("result"))
    return pairs.score_pairs(rows, distinct=True)


_list, _ABBR = oracle.list_of, {k: " ".join(v) for k, v in DEFAULT.abbreviations.items()}


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


QUERIES = {
    "best_place": flagship,
    "candidate_scores": candidate_scores,
    "place_matches": place_matches,
    "explained_pairs": explained,
    "score_report": score_report,
    "score_summary": score_summary,
    "summary_by_region": summary_by_region,
    "distinct_pair_scores": distinct_pair_scores,
    "phonetic_codes": phonetic_codes,
    "flat_candidates": flat_candidates,
    "garbage_flags": garbage_flags,
    "folded_text": folded_text,
    "address_tokens": address_tokens,
    "typo_distances": typo_distances,
    "token_ladder": token_ladder,
    "best_region": best_region,
    "edit_tiers": edit_tiers,
    "top_addresses": top_addresses,
}
ORACLE_SQL = {
    "flat_candidates": """WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split(concat(p_name, ' , ', p_brand, ',, ', p_type), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM part)
SELECT p_partkey, l[1] AS name, array_to_string(l[2:], '|') AS aliases FROM p""",
    "garbage_flags": f"""WITH c AS (SELECT conv_id, turn, lower(strip_accents(text)) AS a, lower(CASE turn % 3 WHEN 0 THEN ' N/A 123' WHEN 1 THEN '--' ELSE '42 7' END) AS b, lower(strip_accents(string_split(text, ' ')[1])) AS c FROM conversations)
SELECT conv_id, turn, coalesce({oracle.garbage("a")}, true) AS garbage, coalesce({oracle.garbage("b")}, true) AS known_garbage, coalesce({oracle.garbage("c")}, true) AS first_word_garbage FROM c""",
    "folded_text": "SELECT doc_id, md5(lower(strip_accents(coalesce(text, '')))) AS folded_md5 FROM documents",
    "address_tokens": f"""WITH {_ADDR},
c AS (SELECT s_suppkey, string_split({oracle.CLEAN.format(x="lower(strip_accents(query))")}, ' ') AS q, string_split({oracle.CLEAN.format(x="lower(strip_accents(r_name))")}, ' ') AS r FROM addr),
t AS (SELECT s_suppkey, len(q) AS n_words,
  list_filter(q, lambda x: (len(x) >= 2 OR list_contains({_list(_ABBR)}, x)) AND NOT regexp_full_match(x, '\\d+') AND (list_contains({_list(_ABBR)}, x) OR NOT regexp_matches(x, '^[a-z]\\d+|^\\d+[a-z]+$'))) AS q,
  list_filter(r, lambda x: len(x) >= 2 OR list_contains({_list(_ABBR)}, x)) AS r FROM c),
f AS (SELECT s_suppkey, n_words, list_filter(q, lambda x: NOT list_contains({_list(DEFAULT.address_stopwords)}, x) OR list_contains(r, x) OR list_contains({_list(DEFAULT.directions)}, x)) AS q,
  list_filter(r, lambda x: NOT list_contains({_list(DEFAULT.result_stopwords)}, x)) AS r FROM t),
d AS (SELECT s_suppkey, n_words, list_filter(q, lambda x, i: list_position(q, x) = i) AS q, list_filter(r, lambda x, i: list_position(r, x) = i) AS r FROM f),
e AS (SELECT *, list_concat(q, flatten(list_transform(list_filter(q, lambda x: list_contains({_list(_ABBR)}, x)), lambda x: string_split({_map(_ABBR)}[x], ' ')))) AS e FROM d),
e1 AS (SELECT * EXCLUDE (e), list_filter(e, lambda x, i: list_position(e, x) = i) AS e FROM e),
e2 AS (SELECT * EXCLUDE (e), list_concat(e, flatten(list_transform(list_filter(e, lambda x: list_contains({_list(DEFAULT.alternates)}, x)), lambda x: string_split({_map(DEFAULT.alternates)}[x], ' ')))) AS e FROM e1)
SELECT s_suppkey, n_words, array_to_string(q, ' ') AS query_tokens, array_to_string(r, ' ') AS result_tokens, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ' ') AS enriched FROM e2""",
    "typo_distances": f"WITH {_ADDR}, d AS (SELECT DISTINCT lower(typed) AS q, lower(r_name) AS r FROM addr) SELECT q, r, levenshtein(q, r) AS edits, round(jaro_winkler_similarity(q, r), 6) AS jw FROM d",
    "token_ladder": f"""WITH {_ADDR}, w AS (SELECT DISTINCT unnest(string_split(lower(r_name), ' ')) AS r FROM region UNION SELECT unnest({_list(MEANT)})),
t AS (SELECT DISTINCT unnest(string_split(lower(concat_ws(' ', typed, {SHORT_SQL}, concat(r_name, 's'), substr(r_name, 2), substr(r_name, 3, 4), concat('xy', r_name, 'zw'))), ' ')) AS q FROM addr),
pairs AS (SELECT q, r FROM t, w WHERE q <> ''), {oracle.EVIDENCE} SELECT q, r, method, round(score, 6) AS score, ratio FROM evidence""",
    "best_place": f"""WITH {_CANDIDATES}, {oracle.scored(_CANDIDATE_SRC)}
SELECT s_suppkey, query, r_name, name, score, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS tier
FROM cand JOIN final USING (id) QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, pos) = 1""",
    "candidate_scores": f"""WITH {_CANDIDATES}, {oracle.scored(_CANDIDATE_SRC)}
SELECT s_suppkey, pos, name, score AS final_score, name AS best_variant, 1::INTEGER AS variants_total, concat('{{"', name, '":', score::VARCHAR, '}}') AS all_scores FROM cand JOIN final USING (id)""",
    "place_matches": f"""WITH {_ADDR}, places AS (SELECT n_nationkey::BIGINT AS place_id, n_name AS name FROM nation UNION ALL SELECT r_regionkey::BIGINT + 100, r_name FROM region),
every AS (SELECT s_suppkey, place_id, query, name, s_suppkey::BIGINT * 1000 + place_id AS id FROM addr, places), {oracle.scored("src AS (SELECT id, query, name AS result FROM every)")},
ranked AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, place_id) AS rank, place_id, name, score FROM every JOIN final USING (id) WHERE score > 0)
SELECT s_suppkey, rank, place_id, name, score FROM addr LEFT JOIN (SELECT * FROM ranked WHERE rank <= 3) USING (s_suppkey)""",
    "distinct_pair_scores": f"""WITH {_ADDR}, {oracle.scored("src AS (SELECT s_suppkey AS id, typed AS query, r_name AS result FROM addr)")}
SELECT s_suppkey, typed AS query, r_name AS result, score FROM addr JOIN final ON id = s_suppkey""",
    "score_summary": f"""WITH {_ADDR}, {oracle.scored("src AS (SELECT s_suppkey AS id, query, r_name AS result FROM addr)")}
SELECT count(*) AS total, count(*) FILTER (WHERE score >= 0.75) AS high, count(*) FILTER (WHERE score >= 0.40 AND score < 0.75) AS medium, count(*) FILTER (WHERE score < 0.40) AS low, round(avg(score), 6) AS avg, min(score) AS min, max(score) AS max FROM final""",
    "summary_by_region": f"""WITH {_ADDR}, {oracle.scored("src AS (SELECT s_suppkey AS id, query, r_name AS result FROM addr)")}
SELECT r_name, count(*) AS total, count(*) FILTER (WHERE score >= 0.75) AS high, count(*) FILTER (WHERE score >= 0.40 AND score < 0.75) AS medium, count(*) FILTER (WHERE score < 0.40) AS low, round(avg(score), 6) AS avg, min(score) AS min, max(score) AS max FROM final JOIN addr ON id = s_suppkey GROUP BY r_name""",
    "best_region": f"""WITH {_ADDR}, s AS (SELECT s_suppkey, region.r_name AS best, levenshtein(upper(typed), region.r_name) AS edits FROM addr, region)
SELECT s_suppkey, arg_min(best, (edits, best)) AS best, min(edits) AS edits FROM s GROUP BY s_suppkey""",
    "edit_tiers": f"""WITH {_ADDR}, s AS (SELECT round(1 - levenshtein(upper(typed), r_name)::DOUBLE / 10, 4) AS score FROM addr)
SELECT CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS tier, count(*) AS n, round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM s GROUP BY 1""",
    "top_addresses": f"""WITH {_ADDR}, s AS (SELECT r_name, s_suppkey, levenshtein(upper(typed), r_name) AS edits FROM addr)
SELECT r_name, place, s_suppkey, edits FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY edits, s_suppkey) AS place FROM s) WHERE place <= 3""",
}
