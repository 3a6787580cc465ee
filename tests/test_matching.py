"""Golden cases of the rule operators, and agreement between strategies and partitionings."""

import random
import re

import pytest

from parley.functions.terms import term_pattern, term_words
from parley.operators import matching as M
from parley.operators.rules import rules_from_dicts
from parley.plans.runs import classify_run

CASES = [
    (dict(terms=["billing", "overcharge*"], operators=["AND"]), "I was overcharged on my billing", True),
    (dict(terms=["billing", "overcharge*"], operators=["AND"]), "My billing looks fine", False),
    (dict(terms=["refund", "reimbursement"], operators=["OR"]), "I need a refund", True),
    (dict(terms=["refund", "reimbursement"], operators=["OR"]), "a reimbursement please", True),
    (dict(terms=["refund", "reimbursement"], operators=["OR"]), "I love this product", False),
    (dict(terms=["cancel", "retention"], operators=["NOT"]), "I want to cancel my plan", True),
    (dict(terms=["cancel", "retention"], operators=["NOT"]), "cancel but retention offer was good", False),
    (dict(terms=["cancel", "subscription"], operators=["NEAR"], proximity=3), "cancel my subscription", True),
    (dict(terms=["cancel", "subscription"], operators=["NEAR"], proximity=3), "subscription: do cancel", True),
    (dict(terms=["cancel", "subscription"], operators=["NEAR"], proximity=3),
     "cancel the order and check subscription later", False),
    (dict(terms=["wide", "open"], operators=["NEAR"], proximity=7), "wide a b c d e f open", True),
    (dict(terms=["wide", "open"], operators=["NEAR"], proximity=7), "wide a b c d e f g open", False),
    (dict(terms=["charge", "service charge"], operators=["NOT LIKE"]), "extra charge on my bill", True),
    (dict(terms=["charge", "service charge"], operators=["NOT LIKE"]), "The service charge is standard", False),
    (dict(terms=["case #"]), "see case #5", True),
    (dict(terms=["case #"]), "see case # 5", False),
    (dict(terms=["hello"], position="END", within_words=2), "say hello", True),
    (dict(terms=["hello"], position="END", within_words=2), "hello a b c", False),
    (dict(terms=["hello"], position="START", within_words=2), "Hello a b c", True),
    (dict(terms=["broken"], sent_by="Customer"), "Agent: is it broken\nCustomer: no\n fine", False),
    (dict(terms=["broken"], sent_by="Customer"), "Agent: hi\r\nCustomer: it is\rbroken", True),
    (dict(terms=["broken"], sent_by="Customer"), "no labels, but broken", True),
    (dict(terms=["plan"], exclude_if=["family plan"]), "my plan", True),
    (dict(terms=["plan"], exclude_if=["family plan"]), "my family plan", False),
    (dict(terms=["t"]), "été", False),
    (dict(terms=["plan"]), None, False),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_operator(spark, i):
    rule, text, expected = CASES[i]
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = M.classify(df, [{"rule_id": "R", "l1": "Hit", **rule}], "t").first()
    assert (got.l1 == "Hit") is expected
    assert got.match_score == 0 if not expected else got.match_score >= 20


def test_best_rule_and_scores(spark):
    rules = [dict(rule_id="A", terms=["one"], l1="A"), dict(rule_id="B", terms=["two words"], l1="B"),
             dict(rule_id="C", terms=["three"], l1="C", l2="S", sentiment="negative")]
    df = spark.createDataFrame([(1, "three one"), (2, "one two words"), (3, "nothing")], "id int, t string")
    got = {r.id: r for r in M.classify(df, rules, "t", with_sentiment=True).collect()}
    assert (got[1].matched_rule, got[1].match_score, got[1].confidence) == ("A", 20, 0.2)
    assert (got[2].matched_rule, got[2].match_score, got[2].match_detail) == ("B", 30, "two words")
    assert (got[3].l1, got[3].l2, got[3].confidence, got[3].matched_rule) == ("Uncategorized", "NA", 0.0, "")


def test_blank_terms_take_their_operator_along(spark):
    rules = rules_from_dicts(spark, [dict(rule_id="R", terms=["a", " ", "b"], operators=["AND", "OR"], l1="X")])
    row = rules.first()
    assert (row.terms, row.operators) == (["a", "b"], ["OR"])


def _random_rules(seed, n=40):
    rnd = random.Random(seed)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]

    def term():
        return " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 1, 1, 2])))

    out = []
    for i in range(n):
        k = rnd.choice([1, 2, 3])
        out.append(dict(rule_id=f"R{i}", terms=[term() for _ in range(k)],
                        operators=[rnd.choice(["AND", "OR", "NOT", "NOT LIKE", "NEAR"]) for _ in range(k - 1)],
                        proximity=rnd.choice([None, 1, 3, 8]), exclude_if=[term()] if rnd.random() < 0.2 else [],
                        l1=f"L{i}"))
    texts = [(i, rnd.choice(["", "-"]) + rnd.choice([" ", ", "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 9))))
             for i in range(60)]
    return out, texts


def _brute(rule, text):
    """The rule by plain regular expressions, one text at a time."""
    low = text.lower()

    def spans(t):
        return [m.span() for m in re.finditer(rf"\b{re.escape(t)}\b", low)]

    def near(a, b, n):
        if n <= 5:
            gap = r"\W+(?:\w+\W+){0,%d}" % n
            pa, pb = rf"\b{re.escape(a)}\b", rf"\b{re.escape(b)}\b"
            return bool(re.search(f"{pa}{gap}{pb}|{pb}{gap}{pa}", low))
        pos = [[len(low[:s].split()) for s, _ in spans(t)] for t in (a, b)]
        return any(abs(p - q) <= n for p in pos[0] for q in pos[1])

    state = bool(spans(rule["terms"][0]))
    for i, op in enumerate(rule["operators"], 1):
        t = rule["terms"][i]
        has = bool(spans(t))
        if op == "OR":
            state = state or has
        elif op in ("NOT", "NOT LIKE"):
            state = state and not has
        elif op == "NEAR":
            state = state and has and near(rule["terms"][i - 1], t, rule["proximity"] or 5)
        else:
            state = state and has
    return state and not any(spans(e) for e in rule["exclude_if"])


def _score(rule):
    return (10 + 10 * sum(len(t.split()) for t in rule["terms"]) + (10 if rule["operators"] else 0)
            + (15 if "NEAR" in rule["operators"] else 0) + (5 if "NOT LIKE" in rule["operators"] else 0))


def test_against_brute_force_and_between_strategies(spark):
    rules, texts = _random_rules(7)
    df = spark.createDataFrame(texts, "id int, t string")
    expected = {}
    for i, t in texts:
        hits = [(-_score(r), n) for n, r in enumerate(rules) if _brute(r, t)]
        expected[i] = rules[min(hits)[1]]["rule_id"] if hits else ""
    inline = {r.id: r.matched_rule for r in M.classify(df.repartition(13), rules, "t").collect()}
    assert inline == expected
    one = {r.id: r.matched_rule for r in M.classify(df.coalesce(1), rules, "t").collect()}
    assert one == expected
    table = rules_from_dicts(spark, rules)
    as_table = {r.id: r.matched_rule for r in M.classify(df, table, "t").collect()}
    assert as_table == expected
    all_hits = {(r.id, r.rule_id) for r in M.rule_hits_all(df, rules, "t", "id").collect()}
    assert all_hits == {(i, r["rule_id"]) for i, t in texts for r in rules if _brute(r, t)}


def test_every_row_is_decided_on_its_own(spark):
    rules = [dict(rule_id="A", terms=["aa"], l1="A"), dict(rule_id="B", terms=["bb"], l1="B")]
    df = spark.createDataFrame([(1, "aa"), (1, "bb"), (None, "aa"), (None, None)], "id int, t string")
    assert sorted(r.l1 for r in M.classify(df, rules, "t").collect()) == ["A", "A", "B", "Uncategorized"]
    assert M.classify(df.where("false"), rules, "t").collect() == []
    assert {r.l1 for r in M.classify(df, [], "t").collect()} == {"Uncategorized"}
    assert M.rule_hits_all(df, [], "t", "id").collect() == []


def test_wildcards_and_marks(spark):
    terms = ["over*", "*over", "o*r", "ab* cd", "#", "case #", "é*", "x.y", "naïve*", "overch*e"]
    texts = ["overcharge", "hangover", "or", "abx cd", "a#b", "a # b", "see case #5", "été", "x.y", "xzy", "naïvety",
             "over", "Overcharge", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r.id, r.rule_id) for r in
           M.rule_hits_all(df, [dict(rule_id=t, terms=[t]) for t in terms], "t", "id").collect()}
    want = {(i, t) for i, x in enumerate(texts) for t in terms
            if re.search(r"\b" + r"\w*".join(re.escape(p) for p in t.split("*")) + r"\b", x.lower())}
    assert got == want


def test_long_mixed_list(spark):
    rules, texts = _random_rules(11, 2_500)
    df = spark.createDataFrame(texts, "id int, t string")
    expected = {}
    for i, t in texts:
        hits = [(-_score(r), n) for n, r in enumerate(rules) if _brute(r, t)]
        expected[i] = rules[min(hits)[1]]["rule_id"] if hits else ""
    assert {r.id: r.matched_rule for r in M.classify(df, rules, "t").collect()} == expected


def test_plan_of_a_classification(spark, tmp_path):
    spark.createDataFrame([(1, "en", "aa")], "id int, lang string, t string").write.parquet(str(tmp_path / "d"))
    out = M.classify(spark.read.parquet(str(tmp_path / "d")), [dict(rule_id="A", terms=["aa", "b*"], operators=["OR"], l1="A")], "t")
    plan = out.where("lang = 'en' and l1 = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan
    assert "Exchange" not in plan and "Join" not in plan and "from_json" not in plan
    assert plan.count("array_min") == 1


def test_plan_of_a_run(spark, tmp_path):
    spark.createDataFrame([(1, "en", "aa"), (2, "de", "aa")], "id int, lang string, t string").write.parquet(str(tmp_path / "d"))
    out = classify_run(spark.read.parquet(str(tmp_path / "d")), [dict(rule_id="A", terms=["aa"], l1="A")], "id", "t")
    kept = out.where("lang = 'en' and Category = 'A'")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and plan.count("array_min") == 1
    assert [r.Conversation_ID for r in kept.collect()] == [1]


def test_terms():
    assert term_words("cancel* my plan") == ["my", "plan"]
    assert term_words("case #") == ["case"]
    assert term_pattern("a.b").startswith(r"a\.b")


def test_a_frequent_word_leads_to_no_phrases_and_single_terms_are_not_decided(spark):
    """80 phrases with "the": none is looked at in a text without their own word."""
    rules = [{"rule_id": f"P{i}", "terms": [f"the word{i}" if i % 2 else f"word{i} the"], "l1": "Phrase"} for i in range(80)]
    rules += [{"rule_id": "N", "terms": ["near", "the"], "operators": ["NEAR"], "proximity": 3, "l1": "Near"}]
    index = M.Index(M.read_rules(rules_from_dicts(spark, rules)))
    assert [e["t"] for b in index.buckets for e in b if e["k"] == "the"] == [t for t, e in enumerate(index.terms) if e["word"] == "the"]
    assert sum(len(e["sure"]) for e in index.split) == 80 and sum(len(e["asked"]) for e in index.split) == 2
    texts = [(1, "so the word3 came"), (2, "the, word3"), (3, "the word33"), (4, "bathe word3"), (5, "word4 the end"),
             (6, "near is the"), (7, "the the the"), (8, "near only"), (9, "near one two three four five the"), (10, None)]
    got = M.rule_hits_all(spark.createDataFrame(texts, "id int, t string"), rules, "t", "id").collect()
    assert sorted((r.id, r.rule_id) for r in got) == [(1, "P3"), (3, "P33"), (5, "P4"), (6, "N")]
