"""Candidates for addresses from a whole gazetteer, by an inverted index over tokens.

A pair scores above 0 only if a token of the address, or what it stands for, gives evidence for a
token of the name, or if the folded texts are equal, or if the one token is like the name written
as one word. So distinct tokens of both sides meet by keys (``token_keys``) that any such two
share; each distinct pair of tokens is judged once; the texts that hold them are joined by them,
and each distinct pair of texts is scored once. All joins are on equal keys, and a key that much
of the input has is left to Spark to split.

Defined cases: null and garbage texts have no candidate; repeated texts are scored once and joined
back to their rows; empty tables give empty results.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelink.functions.kernels import metaphone, porter_stem, soundex
from placelink.lexicons import DEFAULT, Config
from placelink.operators.pairs import _scorer, score_pairs, variants

#: Letters from rare to common: any order is correct, this one makes keys with few members.
RARE_FIRST = "qjxzwvkfybhgpmducltsrnoiea"
#: Longer tokens meet by one letter rather than two, as two of them would be keys by the square of the length.
LONG = 24
#: The least Jaro-Winkler similarity for which the keys are complete.
LEAST_FUZZY = 0.82


def _bag(token: str) -> list[str]:
    """The letters in a fixed order, a repeated one told apart by its turn, later turns first."""
    turn: dict[str, int] = {}
    bag = []
    for c in token:
        turn[c] = turn.get(c, 0) + 1
        bag.append((-turn[c], RARE_FIRST.find(c), c))
    return [f"{c}{-n}" for n, _, c in sorted(bag)]


def _alike_keys(token: str, fuzzy: float, is_query: bool) -> set[str]:
    """Keys that any two tokens share whose Jaro-Winkler similarity reaches ``fuzzy``.

    With a common prefix of l letters Jaro must reach (fuzzy - l / 10) / (1 - l / 10). With m letters
    matched it is (m / a + m / b + 1) / 3 at most for lengths a and b, so m is bounded from below, at
    least 2 unless one has one letter; ordered bags with m letters in common share two of their first
    a - m + 2 letters (prefix filter)."""
    n, bag, keys = len(token), _bag(token), set()
    if n <= 2:  # a token of one letter is like one of two at most
        keys.update(f"1{c}" for c in token)
    if n >= 3:
        keys.add("3" + token[:3])
    for common in range(3):
        if n < max(2, common):
            continue
        share = 3 * (fuzzy - common / 10) / (1 - common / 10) - 2  # of either token's letters
        need = max(2, math.ceil(share * n - 1e-9))
        name = f"{common}{token[:common]} "
        if n <= LONG:
            keys.update(f"b{name}{a}{b}" for a, b in combinations(bag[: n - need + 2], 2))
        if n > LONG * share - 1:  # may be like a long one: the kind says which sides are long
            mixed = "ls" if is_query == (n > LONG) else "sl"
            kinds = ("ll", mixed) if n > LONG else (mixed,)
            keys.update(f"c{kind}{name}{a}" for kind in kinds for a in bag[: n - need + 1])
    return keys


def token_keys(token: str, is_query: bool, config: Config = DEFAULT) -> list[str]:
    """Keys of which a token of an address and one of a name share some if there is evidence between
    them; what a token of an address stands for has keys of its own. A token that starts with a blank is a whole text and meets its equals only."""
    keys = {"=" + token}
    if token.startswith(" "):
        return list(keys)
    if len(token) >= 4:
        keys.add("p" + porter_stem(token))
    if len(token) >= 3:
        keys.update(kind + code for kind, code in (("s", soundex(token)), ("m", metaphone(token))) if code)
    size = config.inside_least
    if len(token) >= size:  # one token inside the other: the first letters of the one are somewhere in the other
        outer, inner = "rq" if is_query else "qr"
        keys.update(outer + token[i : i + size] for i in range(len(token) - size + 1))
        keys.add(inner + token[:size])
    return list(keys | _alike_keys(token, config.fuzzy, is_query))


def _keys(token: Column, is_query: bool, config: Config) -> Column:
    @F.pandas_udf("array<string>")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: token_keys(t, is_query, config))

    return run(token)


def index_tokens(text: str, is_query: bool, config: Config = DEFAULT) -> list[str]:
    """What a text can be found by: its tokens (of an address also what they stand for, of a name
    also all as one word), and, after a blank, itself folded."""
    scorer = _scorer(config)
    folded, garbage, _ = scorer.read(text)
    if garbage:
        return []
    tokens = list(dict.fromkeys(scorer.wanted(text, is_query)))
    if is_query:
        tokens = scorer.expand(tokens)
    else:
        tokens = [t for t in tokens if t not in config.result_stopwords]
        tokens += ["".join(tokens)] if len(tokens) > 1 else []
    return list(dict.fromkeys([*tokens, " " + folded.strip()]))


def _tokens(text: Column, is_query: bool, config: Config) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: index_tokens(t, is_query, config))

    return run(text)


def _related(query_token: Column, name_token: Column, config: Config) -> Column:
    @F.pandas_udf("boolean")
    def run(q: pd.Series, r: pd.Series) -> pd.Series:
        s = _scorer(config)
        return pd.Series([a == b or " " not in (a[0], b[0]) and (s.evidence(a, b).score > 0 or s.same_token(a, b)) for a, b in zip(q, r)], dtype="bool")

    return run(query_token, name_token)


def candidate_pairs(queries: DataFrame, names: DataFrame, query: str = "query", result: str = "result", config: Config = DEFAULT) -> DataFrame:
    """query, result, score: all distinct pairs of an address and a name that score above 0."""
    if config.fuzzy < LEAST_FUZZY or config.compound_fuzzy < config.fuzzy:
        raise ValueError(f"candidates are complete for a fuzzy threshold of at least {LEAST_FUZZY}, and no higher than that of compounds")
    sides = []
    for df, column, is_query, text, token in ((queries, query, True, "query", "q"), (names, result, False, "result", "r")):
        texts = df.select(F.col(column).alias(text)).where(F.col(text).isNotNull()).distinct()
        held = texts.select(text, F.explode(_tokens(F.col(text), is_query, config)).alias(token))
        keys = held.select(token).distinct().select(token, F.explode(_keys(F.col(token), is_query, config)).alias("key"))
        sides.append((held, keys))
    (in_queries, query_keys), (in_names, name_keys) = sides
    related = query_keys.join(name_keys, "key").select("q", "r").distinct().where(_related(F.col("q"), F.col("r"), config))
    found = in_queries.join(related, "q").select("query", "r").distinct().join(in_names, "r").select("query", "result").distinct()
    return score_pairs(found, config=config).where("score > 0")


def match_places(df: DataFrame, places: DataFrame, k: int = 1, query: str = "query", place_id: str = "place_id", config: Config = DEFAULT) -> DataFrame:
    """The columns of ``df``, and rank, ``place_id``, name, best_variant and score of the k best of
    all ``places`` (``place_id``, name, aliases, codes) for each row's address; of equal scores the least
    ``place_id``, of a place's equal variants the first. A row without a place that scores above 0 stays once, with nulls."""
    names = places.select(F.col(place_id).alias("__place"), F.col("name").alias("__name"), F.posexplode(variants(F.col("name"), F.col("aliases"), F.col("codes"))).alias("__at", "result"))
    scored = candidate_pairs(df, names, query, "result", config).withColumnRenamed("query", "__query")
    best = scored.join(names, "result").groupBy("__query", "__place").agg(F.max(F.struct("score", (-F.col("__at")).alias("at"), F.col("result").alias("variant"), "__name")).alias("__best"))
    order = Window.partitionBy("__query").orderBy(F.desc("__best.score"), "__place")
    best = best.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)
    rows = df.join(best, F.col(query) == F.col("__query"), "left")
    own = [df[c] for c in df.columns]
    return rows.select(*own, F.col("__rank").alias("rank"), F.col("__place").alias(place_id), F.col("__best.__name").alias("name"), F.col("__best.variant").alias("best_variant"), F.col("__best.score").alias("score"))
