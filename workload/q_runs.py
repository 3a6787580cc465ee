"""Run history, end-to-end runs and streams."""

from pyspark.sql import functions as F

from parley import fixed_values as fv
from parley.operators import history as H
from parley.plans.runs import FULL_COLUMNS, SHORT_COLUMNS, classify_run, full_run, topics_run
from parley.session import new_path
from parley.streaming.classify_stream import category_trend_stream, stream_classify, trend_table
from workload import sql as S
from workload.data import CONSUMER, docs, results, table, transcripts
from workload.q_classify import (
    BAD,
    BANDS,
    HYBRID,
    LEAVE,
    LEXICON,
    PAY,
    _keyword_first_sql,
    lexicons,
    theme_sql,
    topic_sql,
)
from workload.q_text import _USER_SIMPLE, language_sql
from workload.seed import SEED_GROUPS, SEED_RULES

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


RES = f"WITH {S.classified(SEED_RULES, extra=', lang, n_chars')}"
N_RULES = len(SEED_RULES)

# Every language is one run; a run takes a second per 100,000 characters and starts at a time made from its name.
_RID = "(ascii(lang) * 256 + ascii(substr(lang, 2, 1)))::INT"
_RUNS = f"""runs AS (SELECT {_RID} AS rid, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL ({_RID}) HOUR AS ts,
    count(*) AS tot, count(*) FILTER ("Category" <> 'Uncategorized') AS cat,
    count(*) FILTER ("Category" = 'Uncategorized') AS unc,
    count(*) FILTER ("Category" <> 'Uncategorized') * 100.0::DOUBLE / count(*) AS pct,
    count(DISTINCT "Category") AS ul1, count(DISTINCT "Subcategory") AS ul2, sum(n_chars)::BIGINT / 100000.0::DOUBLE AS secs,
    count(*) / (sum(n_chars)::BIGINT / 100000.0::DOUBLE) AS rps, {N_RULES} AS rn, 0 AS pii FROM res GROUP BY lang),
  fired AS (SELECT {_RID} AS rid, matched_rule AS rule_id, count(*) AS hits, "Category" AS l1 FROM res
    WHERE matched_rule <> '' GROUP BY lang, matched_rule, "Category")"""


def _number():
    return F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))


def _rid():
    return F.first(_number())


def _runs(spark, sf):
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    ts = F.first(F.timestamp_add("HOUR", _number(), start))
    return H.run_summary(results(spark, sf), _rid(), ts, F.sum("n_chars") / F.lit(100000.0), N_RULES, F.lit(0),
                         by=["lang"])


def _hits(spark, sf):
    return H.rule_hits_summary(results(spark, sf), _rid(), by=["lang"])


@query("record_run", f"{RES}, {_RUNS} SELECT * FROM runs")
def _(spark, sf):
    return H.recorded(spark, H.append(_runs(spark, sf), new_path(spark, "history")))


@query("record_rule_hits", f"{RES}, {_RUNS} SELECT * FROM fired")
def _(spark, sf):
    return H.recorded(spark, H.append(_hits(spark, sf), new_path(spark, "hits")))


@query("run_history", f"{RES}, {_RUNS} SELECT * FROM runs ORDER BY ts DESC")
def _(spark, sf):
    path = H.append(_runs(spark, sf), new_path(spark, "history"))
    return H.history(spark, path)


@query("run_drift", f"""{RES}, {_RUNS}, l AS (SELECT * FROM runs ORDER BY ts DESC LIMIT 2)
    SELECT arg_max(pct, ts) - arg_min(pct, ts) AS d_pct, arg_max(rps, ts) - arg_min(rps, ts) AS d_spd FROM l""")
def _(spark, sf):
    return H.drift(_runs(spark, sf))


@query("rule_performance", f"{RES}, {_RUNS} SELECT rule_id, l1, sum(hits)::BIGINT AS hits FROM fired GROUP BY 1, 2")
def _(spark, sf):
    return H.rule_performance(_hits(spark, sf))


_SUPPLIER_RULES = "(SELECT 'SEED-' || lpad(CAST(s_suppkey AS VARCHAR), 2, '0') AS rule_id FROM supplier)"


@query("rules_never_fired", f"""{RES}, {_RUNS} SELECT rule_id FROM {_SUPPLIER_RULES}
    WHERE rule_id NOT IN (SELECT rule_id FROM fired)""")
def _(spark, sf):
    rules = table(spark, sf, "supplier").select(
        F.concat(F.lit("SEED-"), F.when(F.col("s_suppkey") < 10, F.lpad(F.col("s_suppkey").cast("string"), 2, "0"))
                 .otherwise(F.left(F.col("s_suppkey").cast("string"), F.lit(2)))).alias("rule_id"))
    return H.never_fired(rules, _hits(spark, sf))


# --- end to end -----------------------------------------------------------------------------------------------------

_RED = S.redaction(S.VALIDATED)
_RUN_SQL = f"""WITH {_RED}, x AS (SELECT doc_id, r, {S.count_of(S.VALIDATED, '*')}::INT AS total_items FROM red),
    {S.classified(SEED_RULES, 'x', 'doc_id', 'r', ', total_items')}
    SELECT doc_id AS "Conversation_ID", d.text AS "Original_Text", lang, res.text AS redacted_text, total_items,
    total_items > 0 AS pii_detected, "Category", "Subcategory", "L3", "L4", confidence, matched_rule, match_score,
    match_detail FROM res JOIN documents d USING (doc_id)"""


@query("classify_run", _RUN_SQL)
def _(spark, sf):
    out = classify_run(docs(spark, sf), SEED_RULES, "doc_id", "text")
    return out.drop("pii_counts", "source", "n_chars")


_EACH = ", ".join(f"{S.count_of(S.FULL, k)} AS {fv.PII_COUNTERS[k]}" for k in
                  ("EMAIL", "CARD", "SSN", "PHONE", "DOB", "MRN", "IP", "ADDRESS", "CONDITION"))
_JSON = " || ".join(f"CASE WHEN {fv.PII_COUNTERS[k]} > 0 THEN ',\"{fv.PII_COUNTERS[k]}\":' || {fv.PII_COUNTERS[k]} ELSE '' END"
                    for k in ("EMAIL", "CARD", "SSN", "PHONE", "DOB", "MRN", "IP", "ADDRESS", "CONDITION"))


def _full_sql(source="documents", key="doc_id", own="doc_id", kept="doc_id", counts="", types=""):
    """The record; ``key`` makes the ``doc_id`` by which its parts are joined, ``own`` is the id that is given."""
    return f"""WITH {S.redaction(S.FULL, source=source, key=key)}, x AS (SELECT {kept}, text AS original, r AS text, {S.count_of(S.FULL, '*')}::INT AS items{counts} FROM red),
    kf AS ({_keyword_first_sql().replace('FROM documents)', 'FROM x)')}), {theme_sql('x')},
    {LEXICON}, sent AS (SELECT doc_id, avg(pol) AS p FROM (SELECT doc_id, unnest({S.word_tokens('lower(text)')}) AS w FROM x)
      JOIN lx USING (w) GROUP BY doc_id),
    j AS (SELECT *, coalesce(p, 0.0) AS polarity FROM x JOIN kf USING (doc_id) JOIN th USING (doc_id) LEFT JOIN sent USING (doc_id))
    SELECT CAST({own} AS VARCHAR) AS "Conversation_ID", 'Unknown' AS "Industry", original AS "Original_Text",
    text AS "Redacted_Text", text AS "Translated_Text", l1 AS "L1_Category", l2 AS "L2_Subcategory", l3 AS "L3_Tertiary",
    l4 AS "L4_Quaternary", confidence AS "Category_Confidence", match_path AS "Category_Path",
    matched_rule AS "Matched_Rule", primary_proximity AS "Primary_Proximity", proximity_group AS "Proximity_Group",
    theme_count AS "Theme_Count", {BANDS} AS "Sentiment", round(polarity, 9) AS "Sentiment_Score",
    items > 0 AS "PII_Detected", items AS "PII_Items_Redacted"{types} FROM j"""


_FULL_SQL = _full_sql()


def _full(spark, sf):
    out = full_run(docs(spark, sf), SEED_GROUPS, lexicons(spark, sf)[0], "doc_id", "text")
    return out.withColumn("Sentiment_Score", F.round("Sentiment_Score", 9))


@query("classify_full_run", _FULL_SQL)
def _(spark, sf):
    return _full(spark, sf).drop("PII_Types")


# Each row with its own industry and language: sources are companies, the length of their names is the industry.
@query("classify_full_run_own", f"""WITH f AS ({language_sql('"Redacted_Text"', f'({_FULL_SQL})', '"Conversation_ID", "L1_Category"')}),
    c AS (SELECT DISTINCT lower(source) AS c, length(source) AS ino FROM documents WHERE trim(source) <> '' AND lang <> 'fr')
    SELECT f."Conversation_ID", f."L1_Category", f.language AS "Language", coalesce((SELECT 'of ' || min(ino) FROM c
      WHERE contains(trim(lower(d.source || ' site')), c) OR contains(c, trim(lower(d.source || ' site')))), 'Unknown') AS "Industry"
    FROM f JOIN documents d ON f."Conversation_ID" = CAST(d.doc_id AS VARCHAR)""")
def _(spark, sf):
    d, size = docs(spark, sf), F.length("source")
    companies = d.where("lang <> 'fr'").select(size.alias("industry_no"), F.concat(F.lit("of "), size).alias("industry"),
                                               F.lit(0).alias("company_no"), F.col("source").alias("company")).distinct()
    out = full_run(d.withColumn("company", F.concat("source", F.lit(" site"))), SEED_GROUPS, lexicons(spark, sf)[0], "doc_id",
                   "text", company_col="company", companies=companies, language="words")
    return out.select("Conversation_ID", "L1_Category", "Language", "Industry")


# Rows are numbered, so that rows of one id stay apart when the parts of the record are joined.
@query("project_result_full", _full_sql(
    "(SELECT *, row_number() OVER () AS no FROM documents)", "no AS doc_id, doc_id AS own_id", "own_id", "doc_id, own_id",
    f", {_EACH}", f""", '{{' || substr({_JSON}, 2) || '}}' AS "PII_Types\""""))
def _(spark, sf):
    return _full(spark, sf).select(*FULL_COLUMNS)


@query("project_result_short", f'SELECT {", ".join(chr(34) + c + chr(34) for c in SHORT_COLUMNS)} FROM ({_FULL_SQL})')
def _(spark, sf):
    return _full(spark, sf).select(*SHORT_COLUMNS)


def _topics_sql(style):
    return f"""WITH u AS ({_USER_SIMPLE}), al AS (SELECT DISTINCT conv_id FROM conversations WHERE role IN ('user', 'assistant')),
    cons AS (SELECT conv_id, coalesce(consumer, '') AS text FROM al LEFT JOIN u USING (conv_id)),
    lang AS ({language_sql('text', 'cons', 'conv_id')}), {topic_sql(style, 'cons', 'conv_id')},
    {LEXICON}, sent AS (SELECT conv_id, avg(pol) AS p, sum(val) AS v FROM
      (SELECT conv_id, unnest({S.word_tokens('lower(text)')}) AS w FROM cons) JOIN lx USING (w) GROUP BY conv_id),
    j AS (SELECT *, text AS x, coalesce(p, 0.0) AS polarity, coalesce(v, 0.0) AS valence FROM sub JOIN lang USING (conv_id)
      LEFT JOIN sent USING (conv_id)),
    ok AS (SELECT *, language <> 'unknown' AND len({S.words('x')}) >= 3 AS good FROM j)
    SELECT conv_id AS "Conversation_Id", x AS "Consumer_Text", '' AS "Translated_Text",
    CASE WHEN NOT good THEN '' WHEN {PAY} OR {LEAVE} THEN 'subscription issue' ELSE topic END AS "Category",
    CASE WHEN NOT good THEN '' WHEN {PAY} THEN 'payment' WHEN {LEAVE} THEN 'cancel' ELSE subtopic END AS "Subcategory",
    CASE WHEN NOT good THEN '' WHEN {BAD} THEN 'negative' ELSE {HYBRID} END AS "Sentiment" FROM ok"""


@query("classify_topics_run", _topics_sql("v1"))
def _(spark, sf):
    return topics_run(transcripts(spark, sf, CONSUMER, "simple"), "conv_id", "transcript", *lexicons(spark, sf))


# --- streams: the tables read as arriving files ---------------------------------------------------------------------

def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/{name}.parque[t]")


@query("stream_classify", _RUN_SQL)
def _(spark, sf):
    sink, check = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    stream_classify(_stream(spark, sf, "documents"), SEED_RULES, "doc_id", "text", sink, check).awaitTermination()
    return spark.read.parquet(sink).drop("pii_counts", "source", "n_chars")


@query("stream_category_trend", """SELECT date_trunc('day', ts) AS window_start, event_type AS "Category", count(*) AS "Count"
    FROM events GROUP BY 1, 2""")
def _(spark, sf):
    sink, check = new_path(spark, "trend"), new_path(spark, "trend-checkpoint")
    events = _stream(spark, sf, "events").withColumnRenamed("event_type", "Category")
    category_trend_stream(events, "ts", "Category", "1 day", sink, check).awaitTermination()
    return trend_table(spark, sink, "Category")
