"""Rule matching and the scoring classifiers."""

import json

from pyspark.sql import functions as F

from parley import fixed_values as fv
from parley.functions.text import word_tokens
from parley.operators.matching import classify, rule_hits_all
from parley.operators.rules import pack_rules, rules_from_dicts, union_rules
from parley.operators.scorers import (
    apply_overrides,
    classify_keyword_first,
    classify_subtopics,
    classify_topics,
    classify_weighted,
    detect_industry,
    proximity_themes,
    read_lexicon,
    sentiment_bands,
    sentiment_hybrid,
)
from parley.session import new_path
from parley.sources.packs import load_packs
from workload import sql as S
from workload.data import docs, table, transcripts
from workload.q_text import TURNS
from workload.seed import PACK_GROUPS, PACK_RULES, SEED_GROUPS, SEED_RULES, SPEAKER_RULES

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


# --- one query per kind of matching: the texts which a single rule matches ------------------------------------------

_ONE = {
    "match_term": dict(terms=["thre"]),
    "match_wildcard": dict(terms=["thanea*"]),
    "match_and": dict(terms=["thing", "erin"], operators=["AND"]),
    "match_or": dict(terms=["ertion", "attion"], operators=["OR"]),
    "match_not": dict(terms=["thble", "thed"], operators=["NOT"]),
    "match_not_like": dict(terms=["eron", "of the"], operators=["NOT LIKE"]),
    "match_near": dict(terms=["thre", "the"], operators=["NEAR"], proximity=3),
    "match_near_wide": dict(terms=["erin", "and"], operators=["NEAR"], proximity=8),
    "exclude_if": dict(terms=["anin"], exclude_if=["thon", "of the"]),
    "match_position": dict(terms=["the"], position="START", within_words=10),
    "match_position_end": dict(terms=["the"], position="END", within_words=10),
    "mixed_operator_chain": dict(terms=["erth*", "ering", "shtion"], operators=["OR", "AND"]),
}


def _one(name, rule):
    rule = {"rule_id": "R1", "l1": "Hit", **rule}

    @query(name, f"WITH {S.prepared()} SELECT doc_id FROM prep WHERE {S.rule_predicate(rule)}")
    def _(spark, sf):
        out = classify(docs(spark, sf).select("doc_id", "text"), [rule], "text")
        return out.where("l1 = 'Hit'").select("doc_id")


for _name, _rule in _ONE.items():
    _one(_name, _rule)


@query("match_sent_by", f"""WITH {TURNS}, s AS (SELECT conv_id, role, lower(text) AS low FROM t),
    c AS (SELECT conv_id, bool_or(role = 'user' AND regexp_matches(low, {S.q(S.bounded('the'))})) AS cust,
      bool_or(role = 'assistant' AND regexp_matches(low, {S.q(S.bounded('der'))})) AS agent,
      bool_or(role <> 'system' AND regexp_matches(low, {S.q(S.bounded('le'))})) AS fr FROM s GROUP BY conv_id
      HAVING bool_or(role <> 'system'))
    SELECT conv_id, CASE WHEN cust THEN 'Customer English' WHEN agent THEN 'Agent German' WHEN fr THEN 'French'
      ELSE 'Uncategorized' END AS l1 FROM c""")
def _(spark, sf):
    return classify(transcripts(spark, sf), SPEAKER_RULES, "transcript").select("conv_id", "l1")


_RES = f"WITH {S.classified(SEED_RULES)}"
_OUT = """doc_id, "Category" AS l1, "Subcategory" AS l2, "L3" AS l3, "L4" AS l4, confidence, matched_rule,
    match_score, match_detail"""


@query("classify", f"{_RES} SELECT {_OUT} FROM res")
def _(spark, sf):
    return classify(docs(spark, sf), SEED_RULES, "text").drop("text", "lang", "source", "n_chars")


@query("rule_sentiment", f"{_RES} SELECT doc_id, matched_rule, rule_sentiment FROM res")
def _(spark, sf):
    return classify(docs(spark, sf), SEED_RULES, "text", with_sentiment=True).select(
        "doc_id", "matched_rule", "rule_sentiment")


@query("classify_by_join", f"{_RES} SELECT {_OUT} FROM res")
def _(spark, sf):
    # The rules as a table; no id takes part.
    return classify(docs(spark, sf).select("doc_id", "text"), rules_from_dicts(spark, SEED_RULES), "text").drop("text")


# A pack of 320 rules read from its files, and the custom rules behind it.
@query("classify_pack", f"WITH {S.classified(PACK_RULES + SEED_RULES)} SELECT {_OUT} FROM res")
def _(spark, sf):
    folder = new_path(spark, "pack")
    for kind, groups in (("rules", PACK_GROUPS), ("keywords", [])):
        spark.createDataFrame([(json.dumps(groups),)], "value string").write.text(f"{folder}/Demo/{kind}.json")
    rules = union_rules(pack_rules(load_packs(spark, folder), "Demo"),
                        rules_from_dicts(spark, SEED_RULES))
    return classify(docs(spark, sf), rules, "text").select(
        "doc_id", "l1", "l2", "l3", "l4", "confidence", "matched_rule", "match_score", "match_detail")


# A long rule list: the words of the benchmark texts.
_BENCH_WORDS = f"""w AS (SELECT DISTINCT w FROM (SELECT unnest({S.word_tokens('lower(text)')}) AS w FROM benchmark)),
    {S.prepared()}, h AS (SELECT doc_id, w, 10 + 10 AS score FROM (SELECT doc_id, unnest(list_distinct(toks)) AS w
      FROM prep) JOIN w USING (w))"""


@query("classify_long_list", f"""WITH {_BENCH_WORDS}, b AS (SELECT doc_id, arg_min(w, substr(sha256(w), 1, 15)) AS w FROM h GROUP BY doc_id)
    SELECT doc_id, coalesce(w, 'Uncategorized') AS l1, CASE WHEN w IS NULL THEN 0 ELSE 20 END AS match_score
    FROM documents LEFT JOIN b USING (doc_id)""")
def _(spark, sf):
    # Equal scores are tried in the order of a hash of the word.
    w = table(spark, sf, "benchmark").select(F.explode(word_tokens(F.lower("text"))).alias("w")).distinct()
    ordered = w.withColumn("no", F.conv(F.substring(F.sha2("w", 256), 1, 15), 16, 10).cast("long"))
    rules = ordered.select(
        F.lit("").alias("rule_id"), F.array("w").alias("terms"), F.array().cast("array<string>").alias("operators"),
        F.lit(None).cast("int").alias("proximity"), F.lit(None).cast("string").alias("position"),
        F.lit(50).alias("within_words"), F.lit(None).cast("string").alias("sent_by"),
        F.array().cast("array<string>").alias("exclude_if"), F.col("w").alias("l1"), F.lit("NA").alias("l2"),
        F.lit("NA").alias("l3"), F.lit("NA").alias("l4"), F.lit("words").alias("source"),
        F.lit(None).cast("string").alias("sentiment"), F.col("no").cast("long").alias("ordinal"))
    out = classify(docs(spark, sf).select("doc_id", "text"), rules, "text")
    return out.select("doc_id", "l1", "match_score")


@query("rule_hits_all", f"""{_RES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rnk)::INT AS hit_no,
    rule_id, score, detail, l1, l2, l3, l4 FROM pairs JOIN ranked USING (ord)""")
def _(spark, sf):
    return rule_hits_all(docs(spark, sf), SEED_RULES, "text", "doc_id")


# --- scorers --------------------------------------------------------------------------------------------------------

def _group_rows():
    order = sorted(SEED_GROUPS, key=lambda g: (g["kind"] != "keywords", g["group_no"]))
    rows = [f"({i}, {S.q(g['kind'])}, {S.qlist(sorted(g['conditions'], key=len, reverse=True))}, "
            f"{S.qlist(g['conditions'])}, {S.q(g['l1'])}, {S.q(g['l2'])}, {S.q(g['l3'])}, {S.q(g['l4'])})"
            for i, g in enumerate(order)]
    return order, "(VALUES " + ", ".join(rows) + ") v(g, kind, conds, filed, l1, l2, l3, l4)"


def _gate(g):
    return "(" + " OR ".join(S.has(c) for c in g["conditions"]) + ")"


def _weighted_sql():
    order, values = _group_rows()
    gates = ", ".join(f"CASE WHEN {_gate(g)} THEN {i} END" for i, g in enumerate(order))
    hit = "list_filter(conds, lambda c: contains(low, c))"
    points = (f"list_sum(list_transform({hit}, lambda c: 10.0::DOUBLE * len(string_split(c, ' ')) "
              f"* (1.0::DOUBLE - (instr(low, c) - 1)::DOUBLE / length(text) * 0.3::DOUBLE)))")
    return f"""WITH {S.prepared()}, packs AS (SELECT * FROM {values}),
    p AS (SELECT *, unnest(list_filter([{gates}], lambda x: x IS NOT NULL)) AS g FROM prep),
    s AS (SELECT doc_id, g, l1, l2, l3, l4, {points} + list_sum(list_transform({hit}, lambda c: length(c)))::DOUBLE
        / length(text) * 50 + CASE WHEN len({hit}) > 1 THEN len({hit}) * 5 ELSE 0 END
        + CASE WHEN kind = 'keywords' THEN 20 ELSE 10 END AS score FROM p JOIN packs USING (g)),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, g) = 1)
    SELECT doc_id, coalesce(l1, 'Uncategorized') AS l1, coalesce(l2, 'NA') AS l2, coalesce(l3, 'NA') AS l3,
      coalesce(l4, 'NA') AS l4, round(CASE WHEN l1 IS NULL THEN 0.0 ELSE least(score / 100, 1.0) END, 6) AS confidence,
      CASE WHEN l1 IS NULL THEN 'Uncategorized' WHEN l3 = 'NA' THEN l1 || ' > ' || l2
        ELSE l1 || ' > ' || l2 || ' > ' || l3 END AS match_path
    FROM documents LEFT JOIN b USING (doc_id)"""


@query("classify_weighted", _weighted_sql())
def _(spark, sf):
    out = classify_weighted(docs(spark, sf).select("doc_id", "text"), SEED_GROUPS, "text")
    return out.drop("text").withColumn("confidence", F.round("confidence", 6))


@query("match_path", f"SELECT doc_id, match_path FROM ({_weighted_sql()})")
def _(spark, sf):
    return classify_weighted(docs(spark, sf).select("doc_id", "text"), SEED_GROUPS, "text").select(
        "doc_id", "match_path")


def _keyword_first_sql():
    order, values = _group_rows()
    kw = " ".join("WHEN " + " OR ".join(f"contains(low, {S.q(c)})" for c in g["conditions"]) + f" THEN {i}"
                  for i, g in enumerate(order) if g["kind"] == "keywords")
    n = [(i, "len(regexp_extract_all(low, " + S.q("|".join(S.esc(c) for c in g["conditions"])) + "))", g)
         for i, g in enumerate(order) if g["kind"] != "keywords"]
    most = "greatest(" + ", ".join(x for _, x, _ in n) + ")"
    pick = " ".join(f"WHEN {x} = {most} THEN {i}" for i, x, _ in n)
    size = " ".join(f"WHEN g = {i} THEN {len(g['conditions'])}" for i, _, g in n)
    return f"""SELECT doc_id, coalesce(l1, 'Uncategorized') AS l1, coalesce(l2, 'NA') AS l2, coalesce(l3, 'NA') AS l3,
      coalesce(l4, 'NA') AS l4, CASE WHEN l1 IS NULL THEN 0.0 WHEN kind = 'keywords' THEN 0.9
        ELSE least(n::DOUBLE / sz, 1.0) * 0.85 END::DOUBLE AS confidence,
      CASE WHEN l1 IS NULL THEN 'Uncategorized' ELSE concat_ws(' > ', l1, l2, l3, l4) END AS match_path,
      CASE WHEN kind = 'keywords' THEN 'keyword_match' WHEN l1 IS NOT NULL
        THEN 'rule_match_' || n || '_conditions' END AS matched_rule
    FROM (SELECT doc_id, n, g, CASE {size} END AS sz FROM (SELECT doc_id, {most} AS n,
      CASE {kw} WHEN {most} > 0 THEN CASE {pick} END END AS g
      FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)))
    LEFT JOIN (SELECT * FROM {values}) USING (g)"""


@query("classify_keyword_first", _keyword_first_sql())
def _(spark, sf):
    return classify_keyword_first(docs(spark, sf).select("doc_id", "text"), SEED_GROUPS, "text").drop("text")


def _topic_terms(style, kws, phrases=True):
    parts = []
    for k in kws:
        if style == "v1":
            if " " not in k and len(k) <= 3:
                parts.append(f"CASE WHEN regexp_matches(low, {S.q(S.bounded(k))}) THEN 1.0 ELSE 0 END")
            else:
                parts.append(f"CASE WHEN contains(low, {S.q(k)}) THEN {1.5 if ' ' in k else 1.0} ELSE 0 END")
        elif " " not in k:
            parts.append(f"CASE WHEN list_contains(ws, {S.q(k)}) THEN 1.0 ELSE 0 END")
        elif phrases:
            parts.append(f"CASE WHEN contains(low, {S.q(k)}) THEN 2.0 ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def topic_sql(style, source="documents", key="doc_id", text="text"):
    """CTEs ending in ``sub``: key, topic, topic_score, subtopic, subtopic_score."""
    scores = ", ".join(f"{_topic_terms(style, kws)} AS t{i}" for i, kws in enumerate(fv.TOPICS.values()))
    best = "greatest(" + ", ".join(f"t{i}" for i in range(len(fv.TOPICS))) + ")"
    names = " ".join(f"WHEN t{i} = {best} THEN {S.q(n)}" for i, n in enumerate(fv.TOPICS))
    sub_scores, sub_best, sub_names = [], [], []
    for j, (topic, children) in enumerate(fv.SUBTOPICS.items()):
        cols = [f"s{j}_{i}" for i in range(len(children))]
        sub_scores += [f"{_topic_terms(style, kws, False)} AS {c}" for c, kws in zip(cols, children.values())]
        top = "greatest(" + ", ".join(cols) + ")"
        sub_best.append(f"WHEN topic = {S.q(topic)} THEN {top}")
        sub_names.append(f"WHEN topic = {S.q(topic)} THEN CASE WHEN {top} = 0 THEN '' "
                         + " ".join(f"WHEN {c} = {top} THEN {S.q(n)}" for c, n in zip(cols, children)) + " END")
    return f"""{S.prepared(source, key, text)}, tops AS (SELECT *, CASE WHEN {best} = 0 THEN '' {names} END AS topic,
        floor({best})::INT AS topic_score FROM (SELECT *, {scores} FROM prep)),
    sub AS (SELECT {key}, text, low, topic, topic_score, CASE {' '.join(sub_names)} ELSE '' END AS subtopic,
        floor(CASE {' '.join(sub_best)} ELSE 0 END)::INT AS subtopic_score FROM (SELECT *, {', '.join(sub_scores)} FROM tops))"""


for _style, _key in (("v1", "classify_topic_weighted"), ("v2", "classify_topic_set")):
    def _topics(style, name):
        @query(name, f"WITH {topic_sql(style)} SELECT doc_id, topic, topic_score FROM sub")
        def _(spark, sf):
            return classify_topics(docs(spark, sf).select("doc_id", "text"), "text", style).drop("text")
    _topics(_style, _key)


# The invented prose hardly ever names a topic, so each text is followed by words that depend on its source.
_TOPICAL = """topical AS (SELECT doc_id, text || CASE source WHEN 'src1' THEN ' my payment and refund' WHEN 'src2'
    THEN ' my account profile' WHEN 'src3' THEN ' alexa and carplay android auto' WHEN 'src4'
    THEN ' cancel subscription' WHEN 'src5' THEN ' upgrade family plan' ELSE '' END AS text FROM documents)"""


def topical(spark, sf):
    s = F.col("source")
    tail = (F.when(s == "src1", " my payment and refund").when(s == "src2", " my account profile")
            .when(s == "src3", " alexa and carplay android auto").when(s == "src4", " cancel subscription")
            .when(s == "src5", " upgrade family plan").otherwise(""))
    return docs(spark, sf).select("doc_id", F.concat("text", tail).alias("text"))


@query("classify_subtopic", f"""WITH {_TOPICAL}, {topic_sql('v1', 'topical')}
    SELECT doc_id, topic, subtopic, subtopic_score FROM sub""")
def _(spark, sf):
    out = classify_subtopics(classify_topics(topical(spark, sf), "text", "v1"), "text", "v1")
    return out.select("doc_id", "topic", "subtopic", "subtopic_score")


@query("classify_subtopic_set", f"""WITH {_TOPICAL}, {topic_sql('v2', 'topical')}
    SELECT doc_id, topic, subtopic, subtopic_score FROM sub""")
def _(spark, sf):
    out = classify_subtopics(classify_topics(topical(spark, sf), "text", "v2"), "text", "v2")
    return out.select("doc_id", "topic", "subtopic", "subtopic_score")


PAY = "(" + " OR ".join(f"contains(low, {S.q(w)})" for w in fv.FORCE_PAYMENT) + ")"
BAD = "(" + " OR ".join(f"contains(low, {S.q(w)})" for w in fv.FORCE_NEGATIVE) + ")"
LEAVE = "(contains(low, 'cancel') AND contains(low, 'subscription'))"


@query("override_rules", f"""WITH {_TOPICAL}, {topic_sql('v1', 'topical')} SELECT doc_id,
    CASE WHEN {PAY} OR {LEAVE} THEN 'subscription issue' ELSE topic END AS topic,
    CASE WHEN {PAY} THEN 'payment' WHEN {LEAVE} THEN 'cancel' ELSE subtopic END AS subtopic,
    CASE WHEN {BAD} THEN 'negative' ELSE 'neutral' END AS sentiment FROM sub""")
def _(spark, sf):
    out = classify_subtopics(classify_topics(topical(spark, sf), "text", "v1"), "text", "v1")
    out = apply_overrides(out.withColumn("sentiment", F.lit("neutral")), "text")
    return out.select("doc_id", "topic", "subtopic", "sentiment")


def theme_sql(source="documents", key="doc_id", text="text"):
    """CTE ``th``: key, primary_proximity, proximity_group, theme_count."""
    hits = ", ".join("CASE WHEN " + " OR ".join(f"contains(low, {S.q(k)})" for k in kws) + f" THEN {S.q(n)} END"
                     for n, kws in fv.THEMES.items())
    return f"""th AS (SELECT {key}, coalesce(hs[1], 'Uncategorized') AS primary_proximity,
      CASE WHEN len(hs) = 0 THEN 'Uncategorized' ELSE array_to_string(list_sort(hs), ', ') END AS proximity_group,
      len(hs)::INT AS theme_count FROM (SELECT {key}, list_filter([{hits}], lambda h: h IS NOT NULL) AS hs
      FROM (SELECT {key}, lower(coalesce({text}, '')) AS low FROM {source})))"""


@query("proximity_themes", f"WITH {theme_sql()} SELECT * FROM th")
def _(spark, sf):
    return proximity_themes(docs(spark, sf).select("doc_id", "text"), "text").drop("text", "matched_themes")


# --- sentiment: the lexicons are made from the words of the benchmark texts ------------------------------------------

def lexicons(spark, sf):
    w = table(spark, sf, "benchmark").select(F.explode(word_tokens(F.lower("text"))).alias("word")).distinct()
    n = F.length("word")
    return (read_lexicon(w.withColumn("weight", (n % 9 - 4) / 4.0)),
            read_lexicon(w.withColumn("weight", (n % 11 - 5).cast("double"))))


LEXICON = f"""lx AS (SELECT w, (length(w) % 9 - 4) / 4.0::DOUBLE AS pol, (length(w) % 11 - 5)::DOUBLE AS val FROM
    (SELECT DISTINCT w FROM (SELECT unnest({S.word_tokens('lower(text)')}) AS w FROM benchmark)))"""


def sentiment_sql(source="documents", key="doc_id", text="text"):
    """CTE ``sen``: key, x (the text), polarity, valence."""
    return f"""{LEXICON}, sent AS (SELECT {key}, avg(pol) AS p, sum(val) AS v FROM
      (SELECT {key}, unnest({S.word_tokens(f"lower(coalesce({text}, ''))")}) AS w FROM {source}) JOIN lx USING (w)
      GROUP BY {key}),
    sen AS (SELECT {key}, coalesce({text}, '') AS x, coalesce(p, 0.0) AS polarity, coalesce(v, 0.0) AS valence
      FROM {source} LEFT JOIN sent USING ({key}))"""


HYBRID = f"""CASE WHEN length(regexp_replace(x, '^{S.SP}+|{S.SP}+$', '', 'g')) < 3 THEN ''
    WHEN len({S.words('x')}) < 3 THEN 'neutral'
    WHEN polarity * 0.6::DOUBLE + valence / 5.0 * 0.4::DOUBLE <= -0.75 THEN 'very negative'
    WHEN polarity * 0.6::DOUBLE + valence / 5.0 * 0.4::DOUBLE <= -0.25 THEN 'negative'
    WHEN polarity * 0.6::DOUBLE + valence / 5.0 * 0.4::DOUBLE >= 0.75 THEN 'very positive'
    WHEN polarity * 0.6::DOUBLE + valence / 5.0 * 0.4::DOUBLE >= 0.25 THEN 'positive' ELSE 'neutral' END"""
BANDS = """CASE WHEN polarity >= 0.5 THEN 'Very Positive' WHEN polarity >= 0.1 THEN 'Positive'
    WHEN polarity <= -0.5 THEN 'Very Negative' WHEN polarity <= -0.1 THEN 'Negative' ELSE 'Neutral' END"""


@query("sentiment_hybrid", f"WITH {sentiment_sql()} SELECT doc_id, {HYBRID} AS sentiment FROM sen")
def _(spark, sf):
    return sentiment_hybrid(docs(spark, sf), "text", *lexicons(spark, sf)).select("doc_id", "sentiment")


@query("sentiment_bands", f"""WITH {sentiment_sql()} SELECT doc_id, {BANDS} AS sentiment,
    round(polarity, 9) AS sentiment_score FROM sen""")
def _(spark, sf):
    out = sentiment_bands(docs(spark, sf), "text", lexicons(spark, sf)[0])
    return out.select("doc_id", "sentiment", F.round("sentiment_score", 9).alias("sentiment_score"))


# Companies are the nations of a region; the customer's own nation is part of its company name.
@query("industry_from_company", """WITH m AS (SELECT n_nationkey AS no, n_regionkey AS ino, r_name, lower(n_name) AS c
      FROM nation JOIN region ON n_regionkey = r_regionkey),
    x AS (SELECT c_custkey, trim(lower(CASE WHEN c_acctbal < 0 THEN c_name ELSE ' ' || n_name || ' Group ' END)) AS nm
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, (SELECT arg_min(r_name, ino * 1000 + no) FROM m WHERE contains(nm, c) OR contains(c, nm))
      AS industry FROM x""")
def _(spark, sf):
    n, r, c = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer")
    companies = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_regionkey").alias("industry_no"), F.col("r_name").alias("industry"),
        F.col("n_nationkey").alias("company_no"), F.col("n_name").alias("company"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.when(
        F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.concat(F.lit(" "), "n_name", F.lit(" Group ")))
        .alias("company"))
    return detect_industry(named, "company", companies).select("c_custkey", "industry")


# --- packs with thousands of conditions: the words of the benchmark texts, one group a length ------------------------

_LENGTHS = f"""low AS (SELECT doc_id, lower(text) AS t FROM documents), w AS (SELECT DISTINCT w, length(w) AS n
    FROM (SELECT unnest({S.word_tokens('lower(text)')}) AS w FROM benchmark) WHERE length(w) >= 4)"""


def _length_groups(spark, sf, keywords_from=None):
    w = table(spark, sf, "benchmark").select(F.explode(word_tokens(F.lower("text"))).alias("w")).distinct()
    n = F.length("w")
    kind = F.when(n >= keywords_from, "keywords").otherwise("rules") if keywords_from else F.lit("rules")
    return (w.where(n >= 4).groupBy(n.alias("group_no"), kind.alias("kind")).agg(F.sort_array(F.collect_set("w")).alias("conditions"))
            .select("kind", "group_no", "conditions", F.concat(F.lit("L"), F.col("group_no").cast("string")).alias("l1"),
                    *[F.lit("NA").alias(c) for c in ("l2", "l3", "l4")]))


@query("classify_keyword_first_long", f"""WITH {_LENGTHS},
    kw AS (SELECT doc_id, min(n) AS n FROM low JOIN w ON n >= 12 AND contains(t, w) GROUP BY doc_id),
    g AS (SELECT n, string_agg(w, '|' ORDER BY w) AS p, count(*) AS size FROM w WHERE n < 12 GROUP BY n),
    h AS (SELECT doc_id, n, size, len(regexp_extract_all(t, p)) AS hits FROM low, g),
    best AS (SELECT * FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, n) = 1)
    SELECT d.doc_id, coalesce('L' || coalesce(kw.n, b.n), 'Uncategorized') AS l1, CASE WHEN kw.n IS NOT NULL THEN 0.9
        WHEN b.n IS NULL THEN 0 ELSE least(b.hits / b.size, 1) * 0.85 END::DOUBLE AS confidence,
        CASE WHEN kw.n IS NOT NULL THEN 'keyword_match' WHEN b.n IS NOT NULL THEN 'rule_match_' || b.hits || '_conditions' END
        AS matched_rule FROM documents d LEFT JOIN kw USING (doc_id) LEFT JOIN best b USING (doc_id)""")
def _(spark, sf):
    return classify_keyword_first(docs(spark, sf).select("doc_id", "text"), _length_groups(spark, sf, 12), "text").select(
        "doc_id", "l1", "confidence", "matched_rule")


@query("classify_weighted_long", f"""WITH {_LENGTHS},
    part AS (SELECT DISTINCT doc_id, n FROM (SELECT doc_id, unnest({S.word_tokens('t')}) AS w FROM low) JOIN w USING (w)),
    score AS (SELECT doc_id, n, sum(10.0::DOUBLE * (1 - (instr(t, w) - 1)::DOUBLE / length(t) * 0.3)) + sum(n)::DOUBLE / any_value(length(t)) * 50
        + CASE WHEN count(*) > 1 THEN count(*) * 5 ELSE 0 END + 10 AS s FROM low JOIN w ON contains(t, w) SEMI JOIN part USING (doc_id, n)
        GROUP BY doc_id, n),
    best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, n) = 1)
    SELECT doc_id, coalesce('L' || n, 'Uncategorized') AS l1, CASE WHEN s IS NULL THEN 0 ELSE least(s / 100, 1) END::DOUBLE AS confidence
    FROM documents LEFT JOIN best USING (doc_id)""")
def _(spark, sf):
    return classify_weighted(docs(spark, sf).select("doc_id", "text"), _length_groups(spark, sf), "text").select("doc_id", "l1", "confidence")
