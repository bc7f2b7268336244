"""DataFrame operators: pairs, variants, candidates, report, stream."""

import pytest
from pyspark.sql import functions as F

from placelink.functions import kernels, text
from placelink.operators import pairs
from placelink.operators.scorer import Scorer
from placelink.plans import report
from placelink.sources import cases
from placelink.streaming import scoring

PLACES = "array<struct<name:string,aliases:array<string>,codes:array<string>>>"


def test_pairs_nulls_and_distinct(spark):
    rows = [("CA", "Canada", 1), ("CA", "Canada", 2), (None, "Canada", 3), ("CA", None, 4), ("", "Canada", 5)]
    df = spark.createDataFrame(rows, "query string, result string, __n int")
    want = [(1, 0.88), (2, 0.88), (3, None), (4, None), (5, 0.0)]
    for distinct in (False, True):
        got = pairs.score_pairs(df, distinct=distinct).orderBy("__n").collect()
        assert [(r["__n"], r.score) for r in got] == want
    with pytest.raises(Exception, match="must be strings"):
        pairs.score_pairs(df, strict=True).collect()
    assert pairs.score_pairs(df.limit(0)).count() == 0


def test_variants_and_candidates(spark):
    q = [("Holguin", [("Holguín", ["holguín ", "Holguin", None, " "], ["HOG"]), ("", ["Cuba"], None), ("Cuba", None, None)]), (None, [("Iran", None, None)])]
    df = spark.createDataFrame(q, f"query string, candidates {PLACES}")
    got = pairs.score_candidates(df).orderBy("query", "pos").collect()
    assert [(r.pos, r.variants_total, r.final_score) for r in got] == [(0, 1, 0.0), (0, 3, 1.0), (1, 0, 0.0), (2, 1, 0.0)]
    assert got[1].best_variant == "Holguín" and set(got[1].all_scores) == {"Holguín", "Holguin", "HOG"}
    top = pairs.best_candidates(df, 2).where("query IS NOT NULL").orderBy("rank").collect()
    assert [(r.rank, r.pos, r.score) for r in top] == [(1, 0, 1.0), (2, 1, 0.0)]


def test_columns_agree_with_scorer(spark):
    s, rows = Scorer(), ["12/3, Old St. CA-Bharat, #7 7b, na", "  N/A 12", "Ünïted,Kingdom of x", "--", "a1 B2 n", "NW corner (Iran)"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    clean = text.cleaned(text.normalized(F.col("t")))
    got = df.select(text.is_garbage(F.col("t")).alias("g"), text.tokens(clean, True).alias("q"), text.enriched(text.tokens(clean, True)).alias("e")).collect()
    for r, t in zip(got, rows):
        words = s.words(clean_words(t), True)
        assert (r.g, r.q, r.e) == (s.is_garbage(t), words, s.expand(words))


def clean_words(t):
    from placelink.operators.scorer import _BREAKS

    return _BREAKS.sub(" ", kernels.fold(t)).split()


def test_report_and_summary(spark, tmp_path):
    df = cases.cases_from(spark, [("10, Green Apt, Iran", "Iran, IRN, I.R.I."), ("N/A", "Cuba"), ("Korea", "North Korea,, DPRK")])
    rep = report.report(df).orderBy("sno").collect()
    assert [(r.final_score, r.tier, r.variants_total) for r in rep] == [(1.0, "HIGH", 3), (0.0, "LOW", 1), (0.45, "MEDIUM", 2)]
    s = report.summary(report.report(df)).first()
    assert (s.total, s.high, s.medium, s.low, s["min"], s["max"]) == (3, 1, 1, 1, 0.0, 1.0)
    for kind in cases.FORMATS:
        if kind != "orc":
            cases.write_report(report.report(df), str(tmp_path / kind), kind)
    df.write.json(str(tmp_path / "cases"))
    assert cases.read_cases(spark, str(tmp_path / "cases"), "json").count() == 3


def test_explain_paths(spark):
    df = spark.createDataFrame([("N/A", "x"), ("Iran", "IRAN"), ("5", "Iran"), ("CA", "Canada")], "q string, r string")
    d = [r.d for r in df.select(pairs.explain_column(F.col("q"), F.col("r")).alias("d")).collect()]
    assert [x.stage1_garbage for x in d] == [True, False, True, False]
    assert d[1].quick_exact and d[1].final_score == 1.0
    assert d[3].stage2_enriched[0] == "ca" and d[3].penalties_applied == ["p3_abbrev_alt_cap: capped at 0.88"]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("Iarn", [("Iran", None, None)])], f"query string, candidates {PLACES}")
    df.write.parquet(str(tmp_path / "in"))
    stream = scoring.score_stream(scoring.read_queries(spark, str(tmp_path / "in"), f"query string, candidates {PLACES}"))
    scoring.write_scores(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r.final_score, r.tier) == (0.82, "HIGH")


def test_sql_functions(spark):
    kernels.register(spark)
    r = spark.sql("SELECT jaro_winkler('martha', 'marhta') a, porter_stem('hopping') b, fold_accents('Éa') c").first()
    assert (round(r.a, 4), r.b, r.c) == (0.9611, "hop", "ea")


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_variants_by_case_blanks_and_composition(spark):
    from placelink.operators.pairs import variants

    df = spark.createDataFrame([("Café", ["Café", " café\t", "Cafe", "\t", "　", None], ["CAFÉ", "C1"])], "name string, aliases array<string>, codes array<string>")
    assert df.select(variants(df.name, df.aliases, df.codes)).first()[0] == ["Café", "Cafe", "C1"]


def test_folding_of_all_of_unicode(spark):
    from placelink.functions.kernels import fold
    from placelink.functions.text import with_normalized

    texts = ["Å", "が", "한국 Seoul", "Łódź İstanbul", "ệ Ǖ", "क़", "é", "", None, "ﬁ Ⅷ", "\U0001D15E x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in with_normalized(df, "t", "f").collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else fold(t) for t in texts]


def test_scores_best_first_and_own_variants_may_repeat(spark):
    from pyspark.sql import functions as F

    from placelink.operators.pairs import with_best_variant

    df = spark.createDataFrame([("Teheran Iran", ["x", "Iran", "Irann", "Iran"])], "query string, variants array<string>")
    r = with_best_variant(df).select("*", F.map_keys("all_scores").alias("names")).first()
    assert r.names[0] == "Iran" and r.best_variant == "Iran" and sorted(r.names) == ["Iran", "Irann", "x"]


def test_command_line(spark, tmp_path, capsys):
    from placelink.__main__ import main
    from placelink.sources import cases

    rows = cases.cases_from(spark, [("10 Green Apt, Iran", "Iran, IRN"), ("Korea", "North Korea"), ("N/A", "x, y")])
    cases.write_report(rows, str(tmp_path / "cases"), "json")
    main(["report", str(tmp_path / "cases"), str(tmp_path / "out"), "--kind", "json", "--out-kind", "csv", "--by-tier"], spark)
    out = capsys.readouterr().out
    assert "'total': 3, 'high': 1, 'medium': 1, 'low': 1" in out
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"tier=HIGH", "tier=MEDIUM", "tier=LOW"}
    main(["explain", "Corea del", "Korea"], spark)
    out = capsys.readouterr().out
    assert "corea ~ korea: 0.7920 fuzzy" in out and out.strip().endswith("final     0.7920")


def test_summary_by_class(spark):
    from placelink.plans import report

    df = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("b", 0.1)], "kind string, final_score double")
    got = {r.kind: (r.total, r.high, r.medium, r.low) for r in report.summary(df, by=("kind",)).collect()}
    assert got == {"a": (2, 1, 1, 0), "b": (1, 0, 0, 1)}
