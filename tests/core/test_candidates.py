"""The token index against all pairs."""

import random

import pytest

from placelink.lexicons import DEFAULT, Config
from placelink.operators import candidates
from placelink.operators.scorer import Scorer

WORDS = "united states kingdom korea north south old new saint george georgia iran iraq ca usa bharat guinea bissau oman roman romania mali malawi niger nigeria st e".split()


def misspelt(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word, word, word[:at] + word[at + 1 :], word[:at] + rng.choice("aeinrx") + word[at:], word + "s", "x" + word, word[:at] + word[at:][::-1], word * 4])


def test_keys_are_complete():
    rng, scorer = random.Random(5), Scorer()
    tokens = {misspelt(rng, rng.choice(WORDS)) for _ in range(500)}
    tokens |= {"".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(400)}
    tokens |= {"".join(rng.choices("abcdefgh", k=rng.randint(14, 60))) for _ in range(30)}
    longer = "abcdefghijklmnopqrstuvwxyz"
    tokens = sorted((tokens | {longer[:n] for n in range(8, 27)} | {longer[1:n] for n in range(12, 27)} | {"z" + longer[:n] for n in range(16, 27)}) - {""})
    q = {t: set(candidates.token_keys(t, True)) for t in tokens}
    r = {t: set(candidates.token_keys(t, False)) for t in tokens}
    # what a token stands for is a token of the address itself
    related = [(a, b) for a in tokens for b in tokens if not scorer.stands_for(a, b) and (scorer.evidence(a, b).score > 0 or scorer.same_token(a, b))]
    assert len(related) > 5000
    assert [p for p in related if q[p[0]].isdisjoint(r[p[1]])] == []


def test_pairs_equal_all_pairs(spark):
    rng, scorer = random.Random(7), Scorer()
    queries = [", ".join(misspelt(rng, rng.choice(WORDS)) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    queries += ["I.R.I.", "unitedstates", "northkorea st", "N/A", "", " ", "12 7b", "Ünited Kingdom", "가나 x", "x" * 3000, queries[0]]
    names = [" ".join(rng.sample(WORDS, rng.randint(1, 3))) for _ in range(60)] + ["i.r.i.", "가나", "Korea, North", "na", "", "x" * 2999, "Korea, North"]
    every = spark.createDataFrame([(x,) for x in [*queries, None]], "text string")
    of = spark.createDataFrame([(x,) for x in [*names, None]], "name string")
    got = candidates.candidate_pairs(every, of, "text", "name")
    want = {(a, b, s) for a in queries for b in names if (s := scorer.score(a, b)) > 0}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert candidates.candidate_pairs(every.limit(0), of, "text", "name").count() == 0


def test_places_for_rows_with_any_columns(spark):
    places = spark.createDataFrame([(1, "Iran", ["IRN"], None), (2, "Irann", None, None), (3, "Iran", None, ["I1"]), (4, None, ["Iran"], None)], "place_id long, name string, aliases array<string>, codes array<string>")
    rows = spark.createDataFrame([("Iran", 1, "a"), ("Iran", 1, "a"), (None, 2, "b"), ("zzz", 3, "c")], "query string, name int, score string")
    got = sorted(map(tuple, candidates.match_places(rows, places, 2).select("*").collect()), key=repr)
    once = [("Iran", 1, "a", rank, place, "Iran", "Iran", 1.0) for rank, place in ((1, 1), (2, 3))]
    assert got == sorted([*once, *once, (None, 2, "b", *[None] * 5), ("zzz", 3, "c", *[None] * 5)], key=repr)


def test_thresholds_that_keys_do_not_cover():
    assert DEFAULT.fuzzy >= candidates.LEAST_FUZZY
    with pytest.raises(ValueError, match="complete"):
        candidates.candidate_pairs(None, None, config=Config(fuzzy=0.7))
