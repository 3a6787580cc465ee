"""Transcripts, speakers, packs in their file form, formats, quantiles, keyword in context."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from parley.functions.text import consumer_text, speaker_text
from parley.operators.concordance import kwic, kwic_options
from parley.operators.ordering import running_total
from parley.operators.quantiles import exact_quantiles
from parley.operators.rules import pack_rules
from parley.operators.concordance import kwic_options
from parley.operators.profiling import infer_column_roles, infer_measure_columns, validate_input
from parley.operators.shaping import sanitize_text, unique_names
from parley.operators.transcripts import build_transcripts
from parley.sources.packs import load_company_map, load_packs, load_packs_merged, pack_inventory
from parley.sources.tables import read_csv_unique_names, read_table


@pytest.mark.parametrize("style,text,expected", [
    ("simple", "2025-06-30 09:50:48 +0000 Consumer: I can't login | 2025-06-30 09:51:00 +0000 Agent: Let me help",
     "I can't login"),
    ("multi", "2025-06-30 09:50:48 +0000 Consumer: I can't login | 2025-06-30 09:51:00 +0000 Agent: Let me help",
     "I can't login"),
    ("multi", "[12:30:08 CUSTOMER]: App keeps crashing [12:30:15 AGENT]: I'll investigate", "App keeps crashing"),
    ("multi", "Consumer: No puedo iniciar sesión | Agent: Te ayudo", "No puedo iniciar sesión"),
    ("simple", "Consumer: a | Agent: b | Consumer: c", "a c"),
    ("simple", "Agent: only me", ""),
])
def test_consumer_text(spark, style, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(consumer_text(F.col("t"), style)).first()[0] == expected


def test_speaker_text(spark):
    df = spark.createDataFrame([("intro\nAgent: hello\n more\nClient - yes\r\n no\rrep| bye",)], "t string")
    row = df.select(speaker_text(F.col("t"), "agent").alias("a"), speaker_text(F.col("t"), "customer").alias("c")).first()
    assert (row.a, row.c) == ("hello more bye", "yes no")


def test_one_transcript_whatever_the_turn_numbers(spark):
    turns = spark.range(990, 1015).select(F.lit(1).alias("c"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                   F.col("id").cast("string").alias("text"))
    rows = build_transcripts(turns, "c", "turn", "role", "text", {"user": "Customer"}).collect()
    assert len(rows) == 1
    assert [s.strip() for s in rows[0].transcript.split("Customer: ")[1:]] == [str(i) for i in range(990, 1015)]


def test_packs(spark, tmp_path):
    rules = [{"conditions": ["cancel", "cancel plan"], "set": {"category": "C", "subcategory": "S", "level_3": "T",
                                                              "level_4": "U", "sentiment": "negative"}}]
    keys = [{"conditions": ["bill"], "set": {"category": "B", "subcategory": "P"}}]
    for name, files in {"Bank": {"rules": rules, "keywords": keys}, "Shop": {"keywords": keys}}.items():
        (tmp_path / "p" / name).mkdir(parents=True)
        for kind, docs in files.items():
            (tmp_path / "p" / name / f"{kind}.json").write_text(json.dumps(docs, indent=1))
    (tmp_path / "p" / "Bad").mkdir()
    for kind in ("rules", "keywords"):
        (tmp_path / "p" / "Bad" / f"{kind}.json").write_text("[{")
    for name, text in {"No rules": "[]", "Blank": ""}.items():
        (tmp_path / "p" / name).mkdir()
        (tmp_path / "p" / name / "rules.json").write_text(text)
        (tmp_path / "p" / name / "keywords.json").write_text(json.dumps(keys))
    packs = load_packs(spark, str(tmp_path / "p"))
    assert {r.industry for r in packs.collect()} == {"Bank", "No rules"}
    packs = packs.where("industry = 'Bank'")
    got = [(r.rule_id, r.terms, r.l1, r.l3) for r in pack_rules(packs).orderBy("ordinal").collect()]
    assert got == [("BAN-0001", ["cancel"], "C", "T"), ("BAN-0002", ["cancel plan"], "C", "T"),
                   ("BAN-0003", ["bill"], "B", "NA")]
    expected = spark.createDataFrame([("Bank",), ("Health",)], "industry string")
    status = {r.industry: r.status for r in pack_inventory(spark, str(tmp_path / "p"), expected).collect()}
    assert status == {"Bank": "valid", "Shop": "missing", "Bad": "invalid", "Health": "missing",
                      "No rules": "valid", "Blank": "missing"}
    (tmp_path / "rules.json").write_text(json.dumps([dict(rules[0], domain="Bank"), rules[0]]))
    (tmp_path / "keywords.json").write_text(json.dumps(keys))
    merged = load_packs_merged(spark, str(tmp_path / "rules.json"), str(tmp_path / "keywords.json"))
    assert sorted((r.industry, r.kind) for r in merged.collect()) == [
        ("Bank", "rules"), ("Other", "keywords"), ("Other", "rules")]


def test_company_map(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": "1", "industries": {"Bank": ["A", "B"], "Shop": ["C"]}},
                                                indent=1))
    rows = load_company_map(spark, str(tmp_path / "m.json")).collect()
    assert sorted((r.industry, r.company) for r in rows) == [("Bank", "A"), ("Bank", "B"), ("Shop", "C")]


def test_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in read_table(spark, str(tmp_path / "a.json")).collect()) == [1, 2]
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny ""q"""\n')
    assert read_table(spark, str(tmp_path / "a.csv"), multiline=True).first().t == 'x\ny "q"'
    (tmp_path / "b.csv").write_text("id,t,id\n1,x,2\n")
    assert read_csv_unique_names(spark, str(tmp_path / "b.csv")).dtypes == [("id", "int"), ("t", "string"), ("id_1", "int")]
    typed = read_csv_unique_names(spark, str(tmp_path / "b.csv"), schema="a long, b string, c double")
    assert typed.dtypes == [("id", "bigint"), ("t", "string"), ("id_1", "double")] and typed.first().id_1 == 2.0
    with pytest.raises(ValueError):
        read_table(spark, "a.xlsx")
    assert unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]


def test_sanitize(spark):
    df = spark.createDataFrame([('a\r\nb\rc\n"d"',)], "t string")
    assert sanitize_text(df, "csv").first().t == "a | b | c | 'd'"
    assert sanitize_text(df, "parquet").first().t == 'a | b | c | "d"'
    long = spark.createDataFrame([("\n" * 4000,)], "t string")
    assert len(sanitize_text(long, "parquet").first().t) == 12000
    assert len(sanitize_text(long, "parquet", max_chars=5000).first().t) == 5000


def test_profiles_look_at_all_rows(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 200, "2024-01-01").otherwise("x" * 100).alias("t"))
    assert {r.column: r.date for r in infer_measure_columns(df).collect()} == {"id": False, "t": False}
    assert {r.column: r.text_like for r in infer_column_roles(df).collect()} == {"id": False, "t": True}
    assert {r.check: r.value for r in validate_input(df, ["id"], "t").collect()}["long_enough"] == 82.0


def test_keyword_patterns_must_match_characters(spark):
    df = spark.createDataFrame([("1", "abc xbc", "C", "S", "NA", "NA")],
                               "Conversation_ID string, Original_Text string, Category string, Subcategory string, L3 string, L4 string")
    assert [r.Match_Position for r in kwic_options(df, "x+", regex=True).collect()] == [4]
    with pytest.raises(Exception, match="empty string"):
        kwic_options(df, "x*", regex=True).collect()


def test_quantiles_of_large_and_small_groups(spark):
    rnd = random.Random(3)
    data = ([("big", float(rnd.randint(0, 10 ** 6))) for _ in range(30_000)]
            + [("flat", float(rnd.randint(0, 3))) for _ in range(25_000)] + [("one", 5.0), (None, 1.0), (None, 2.0)])
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect()}
    for g in {d[0] for d in data}:
        vals = [v for k, v in data if k == g]
        want = [vals[0]] * 3 if len(vals) == 1 else statistics.quantiles(vals, n=4, method="inclusive")
        assert [got[g].q1, got[g].m, got[g].q3] == pytest.approx(want)


def test_running_total_over_blocks(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("x").alias("g"), "id")
    got = running_total(df, ["g"], "id", F.lit(2), "before", block=50).where("g = 'hot'").orderBy("id").collect()
    assert [r.before for r in got] == [2 * i for i in range(334)]


def test_kwic_contexts(spark):
    text = "one refund, two-refund three. Refund"
    df = spark.createDataFrame([(1, text, "C", "S", "NA", "NA")],
                               "Conversation_ID int, Original_Text string, Category string, Subcategory string, "
                               "L3 string, L4 string")
    got = [(r.Left, r.KW, r.Right) for r in kwic(df, "refund", 2).orderBy("match_no").collect()]
    assert got == [("one", "refund", ", two-refund"), ("refund, two-", "refund", "three. Refund"),
                   ("two-refund three.", "Refund", "")]
    at = [r.Match_Position for r in kwic_options(df, "re.und", regex=True).orderBy("match_no").collect()]
    assert at == [4, 16, 30]
