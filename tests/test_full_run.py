"""The full record with each row's own industry and language."""

import random

import duckdb

import __spark_entry__ as entry
from check import norm
from parley.functions.pii import with_redaction
from parley.operators import scorers
from parley.operators.language_model import fit_language
from parley.operators.scorers import proximity_themes, sentiment_bands, with_language, with_tokens
from parley.plans.runs import FULL_COLUMNS, full_run
from parley.session import materialize
from workload.seed import SEED_GROUPS

ROWS = [(1, "the bill is wrong and that is it", "Acme Ltd"), (2, None, "Nobody"), (None, "la note est fausse", None), (4, "", " ")]


def test_own_industry_and_language(spark):
    df = spark.createDataFrame(ROWS, "redacted_text int, l1 string, company string")  # names the run uses itself
    companies = spark.createDataFrame([(1, "Tools", 1, "ACME"), (2, "Other", 1, " ")],
                                      "industry_no int, industry string, company_no int, company string")
    model = fit_language(spark.createDataFrame([("en", "the bill is that"), ("fr", "la note est le")], "l string, t string"), "t", "l")
    for language, unknown in (("words", "unknown"), (model, "unknown")):
        out = full_run(df, SEED_GROUPS, {}, "redacted_text", "l1", company_col="company", companies=companies,
                       industry="None", language=language)
        assert out.columns == FULL_COLUMNS + ["Language"]
        assert {r.Conversation_ID: (r.Industry, r.Language, r.Original_Text) for r in out.collect()} == {
            "1": ("Tools", "en", ROWS[0][1]), "2": ("None", unknown, None), None: ("None", "fr", ROWS[2][1]),
            "4": ("None", unknown, "")}


def test_without_either(spark):
    out = full_run(spark.createDataFrame(ROWS, "i int, t string, c string"), SEED_GROUPS, {}, "i", "t")
    assert out.columns == FULL_COLUMNS and {r.Industry for r in out.collect()} == {"Unknown"}


def test_every_stage_is_in_the_record(spark, tmp_path):
    """The query gives what each stage of the run makes, one record a row, repeated ids and null ids included."""
    texts = ["nicht thanedble: call 555-123-4567", "nicht thanedble: call 555-123-4567", None, "cancel the thing, of the bad refund",
             "bad of the: write to a@b.org or c@d.org"]
    ids = [1, 1, 2, None, 2]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "bad thing refund nicht")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["project_result_full"])
    names = [c[0] for c in want.description]
    out = entry.queries()["project_result_full"](spark, str(tmp_path))
    assert out.columns == FULL_COLUMNS == names
    got = out.collect()
    assert sorted((tuple(norm(v) for v in r) for r in got), key=repr) == sorted(
        (tuple(norm(v) for v in r) for r in want.fetchall()), key=repr)
    assert sorted((r.L1_Category, r.Theme_Count > 0, r.Sentiment, r.PII_Types) for r in got) == [
        ("Billing", True, "Negative", '{"emails":2}'), ("Billing", True, "Positive", "{}"),
        ("Product", True, "Positive", '{"phones":1}'), ("Product", True, "Positive", '{"phones":1}'),
        ("Uncategorized", False, "Neutral", "{}")]


def test_redaction_and_classification_run_once(spark, monkeypatch):
    """The names of companies are counted in the table itself, not in the rows of the run."""
    plans = {}

    def written(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(scorers, "materialize", written)
    df = spark.createDataFrame(ROWS, "i int, t string, c string")
    companies = spark.createDataFrame([(1, "Tools", 1, "ACME")], "industry_no int, industry string, company_no int, company string")
    out = full_run(df, SEED_GROUPS, {}, "i", "t", company_col="c", companies=companies, language="words")
    assert sorted(r.Industry for r in out.collect()) == ["Tools", "Unknown", "Unknown", "Unknown"]
    assert "Aggregate" in plans["names"] and "Generate" not in plans["names"] and "Python" not in plans["names"]


def test_a_text_is_lowered_once_for_all_conditions(spark):
    df = spark.createDataFrame([("Diabetes and COVID-19", )], "t string")
    plan = with_redaction(df, "t", "full")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2  # of conditions and of record numbers


def test_themes_by_hand(spark):
    themes = {"z": ["ab", "abc", "b c"], "a": ["bc", "É"], "both": ["abc"], "every": [""], "long": ["cab cab"]}
    r = random.Random(3)
    texts = [None, "", "ABC", "É é"] + ["".join(r.choice("aAbBcC é") for _ in range(n)) for n in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plan = proximity_themes(df, "t", themes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and plan.count("ArrowEvalPython") == 1  # one pass, however many keywords
    for x in proximity_themes(df, "t", themes).collect():
        hits = [name for name, kws in themes.items() if any(k in (texts[x.i] or "").lower() for k in kws)]
        assert (x.matched_themes, x.theme_count, x.primary_proximity, x.proximity_group) == (
            sorted(hits), len(hits), hits[0], ", ".join(sorted(hits)))
    none = proximity_themes(df, "t", {"a": ["nowhere"]}).select("theme_count", "primary_proximity", "proximity_group").distinct().collect()
    assert [tuple(x) for x in none] == [(0, "Uncategorized", "Uncategorized")]


def test_words_given_are_the_words_made(spark):
    """Sentiment and language by words made once, the same as by the text."""
    df = spark.createDataFrame([(t,) for t in ("The bill IS und bad", None, "", "le la la die", "qui est good bad")], "t string")
    given = with_tokens(df, "t", "w")
    weights = {"bad": -1.0, "good": 0.25}
    for f, more in ((sentiment_bands, (weights,)), (with_language, ())):
        want, got = f(df, "t", *more), f(given, "t", *more, tokens_col="w").drop("w")
        assert got.columns == want.columns and sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
