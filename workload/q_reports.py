"""Reports over classified documents (``res``) and over orders with four levels (``ores``)."""

from pyspark.sql import functions as F

from parley.operators import reports as R
from parley.operators.scorers import proximity_themes, sentiment_bands, sentiment_hybrid, with_language
from workload import sql as S
from workload.data import ORDER_RESULTS, docs, order_results, results
from workload.q_classify import BANDS, HYBRID, lexicons, sentiment_sql, theme_sql
from workload.q_text import language_sql
from workload.seed import SEED_RULES

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


RES = f"WITH {S.classified(SEED_RULES)}"
ORES = f"WITH {ORDER_RESULTS}"
pct = S.pct


def on_docs(name, sql, fn):
    query(name, f"{RES} {sql}")(lambda spark, sf: fn(results(spark, sf)))


def on_orders(name, sql, fn):
    query(name, f"{ORES} {sql}")(lambda spark, sf: fn(order_results(spark, sf)))


# --- counts and shares ----------------------------------------------------------------------------------------------

on_docs("run_kpis", f"""SELECT count(*) AS records, count(DISTINCT "Category") AS distinct_category,
    count(DISTINCT "Subcategory") AS distinct_subcategory, count(DISTINCT "L3") AS distinct_l3,
    count(DISTINCT "L4") AS distinct_l4, count(*) FILTER ("Category" <> 'Uncategorized') AS categorized,
    count(*) FILTER ("Category" = 'Uncategorized') AS uncategorized,
    {pct("count(*) FILTER (" + '"Category"' + " <> 'Uncategorized')", 'count(*)')} AS categorized_pct FROM res""",
        R.run_kpis)
on_docs("dist_l1", f"""SELECT "Category", count(*) AS "Count",
    {pct('count(*)', '(SELECT count(*) FROM res)')} AS "Pct" FROM res WHERE "Category" <> 'NA' GROUP BY 1""",
        lambda out: R.level_table(out, "Category"))
on_docs("dist_with_parent", f"""SELECT "Category", "Subcategory", count(*) AS "Count",
    {pct('count(*)', '(SELECT count(*) FROM res)')} AS "Pct" FROM res WHERE "Subcategory" <> 'NA' GROUP BY 1, 2""",
        lambda out: R.level_table(out, "Subcategory", "Category"))
on_orders("dist_pct_of_parent", f"""SELECT *, {pct('"Count"', '(SELECT count(*) FROM res)')} AS "PctOfTotal",
    {pct('"Count"', '"ParentTotal"')} AS "PctOfParent" FROM
    (SELECT "Category", "Subcategory", "L3", count(*) AS "Count" FROM res WHERE "L3" <> 'NA' GROUP BY 1, 2, 3)
    JOIN (SELECT "Category", "Subcategory", count(*) AS "ParentTotal" FROM res GROUP BY 1, 2)
    USING ("Category", "Subcategory")""",
          lambda out: R.level_table_of_parent(out, "L3", ["Category", "Subcategory"]))
on_docs("top_drivers", """SELECT "Category", count(*) AS "Count" FROM res WHERE "Category" <> 'Uncategorized'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""", lambda out: R.top_drivers(out, n=5))
on_docs("top_drivers_prefilter", """SELECT * FROM (SELECT "Category", count(*) AS "Count" FROM res
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) WHERE "Category" <> 'Uncategorized'""",
        lambda out: R.top_drivers(out, n=5, strict=False))
on_orders("top_subcategories", """SELECT "Subcategory", count(*) AS "Count" FROM res WHERE "Subcategory" <> 'NA'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", lambda out: R.top_drivers(out, "Subcategory", 10))
_NAMED = "\"{c}\" NOT IN ('NA', 'Uncategorized')"
on_orders("cross_level_counts", f"""SELECT "Category", "L3", count(*) AS "Count" FROM res
    WHERE {_NAMED.format(c='Category')} AND {_NAMED.format(c='L3')} GROUP BY 1, 2""",
          lambda out: R.cross_tab(out, "Category", "L3"))
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
on_orders("heatmap_pivot", "SELECT \"Subcategory\", " + ", ".join(
    f"count(*) FILTER (\"L3\" = '{s}') AS \"{s}\"" for s in _SEGMENTS) + f""" FROM res
    WHERE {_NAMED.format(c='Subcategory')} AND {_NAMED.format(c='L3')} GROUP BY 1""",
          lambda out: R.heatmap(out, "Subcategory", "L3", 20))
_P = ['"Category"', '"Subcategory"', '"L3"', '"L4"']
on_orders("decomposition_tree", "SELECT 0 AS depth, '' AS path, count(*) AS value FROM res" + "".join(
    f" UNION ALL SELECT {d}, concat_ws(' > ', {', '.join(_P[:d])}), count(*) FROM res WHERE "
    + _NAMED.format(c="Category") + "".join(f" AND {c} <> 'NA'" for c in _P[1:d]) + f" GROUP BY {', '.join(_P[:d])}"
    for d in (1, 2, 3, 4)), R.decomposition_tree)


def _cascade(k):
    ctes, prev = [], "res"
    for i, c in enumerate(_P):
        ctes.append(f"c{i} AS (SELECT * FROM {prev} WHERE {c} IN (SELECT {c} FROM {prev} GROUP BY {c} "
                    f"HAVING count(*) >= {k}))")
        prev = f"c{i}"
    return f"{ORES}, {', '.join(ctes)} SELECT \"Conversation_ID\", {', '.join(_P)} FROM {prev}"


query("min_count_cascade", _cascade(620))(lambda spark, sf: R.min_count_filter(
    order_results(spark, sf).select("Conversation_ID", *R.LEVELS), 620))
on_orders("sunburst_counts", """SELECT "Category", "Subcategory", "L3", "L4", count(*) AS count FROM res
    WHERE "Category" NOT IN ('NA', 'Uncategorized') GROUP BY ALL
    HAVING count(*) > (SELECT count(*) FROM res WHERE "Category" NOT IN ('NA', 'Uncategorized')) * 0.003::DOUBLE""",
          R.sunburst_counts)
_UNC = "count(*) FILTER (\"Category\" = 'Uncategorized')"
on_docs("uncategorized_summary", f"""SELECT count(*) AS records, {_UNC} AS uncategorized,
    {pct(_UNC, 'count(*)')} AS uncategorized_pct FROM res""", R.uncat_summary)
on_docs("uncategorized_unigrams", f"""SELECT ngram, count(*) AS "Count" FROM (SELECT unnest({S.content_tokens('text')})
    AS ngram FROM res WHERE "Category" = 'Uncategorized') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
        lambda out: R.top_ngrams(R.uncategorized(out), 1, 20))
on_docs("uncategorized_bigrams", f"""SELECT ngram, count(*) AS "Count" FROM (SELECT unnest(list_transform(
      range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS ngram FROM
    (SELECT {S.content_tokens('text')} AS t FROM res WHERE "Category" = 'Uncategorized'))
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""", lambda out: R.top_ngrams(R.uncategorized(out), 2, 15))
on_docs("uncategorized_sample", """SELECT doc_id AS "Conversation_ID", text AS "Original_Text" FROM res
    WHERE "Category" = 'Uncategorized' ORDER BY sha256(doc_id || ':42'), doc_id LIMIT 10""",
        lambda out: R.uncat_sample(out, 10))
on_docs("top5_categories", f"""SELECT "Category", n AS "Count", {pct('n', '(SELECT count(*) FROM res)')} AS "Pct" FROM
    (SELECT "Category", count(*) AS n FROM res GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
    WHERE "Category" <> 'Uncategorized' ORDER BY n DESC, 1 LIMIT 5""", R.top5)
on_docs("confidence_bands", """SELECT CASE WHEN match_score <= 30 THEN 'Low' WHEN match_score <= 70 THEN 'Medium'
    ELSE 'High' END AS "Band", count(*) AS "Count" FROM res GROUP BY 1""", R.confidence_bands)
_AUDIT = """SELECT doc_id AS "Conversation_ID", "Category", "Subcategory", "L3", "L4", confidence, matched_rule,
    match_score, match_detail FROM res"""
on_docs("audit_filter", f"{_AUDIT} WHERE match_score BETWEEN 30 AND 70 ORDER BY doc_id LIMIT 300",
        lambda out: R.audit(out, band="Medium", n=300))
on_docs("audit_category", f"{_AUDIT} WHERE \"Category\" = 'Technical'",
        lambda out: R.audit(out, category="Technical", n=None))
_MINE = "\"Category\" IN ('Billing', 'Technical', 'Uncategorized')"
on_docs("custom_report_filter", f"""SELECT count(*) FILTER ({_MINE}) AS records, count(*) AS all_records,
    {pct(f'count(*) FILTER ({_MINE})', 'count(*)')} AS share_pct,
    count(DISTINCT CASE WHEN {_MINE} THEN "Category" END) AS categories,
    count(DISTINCT CASE WHEN {_MINE} AND "Subcategory" <> 'NA' THEN "Subcategory" END) AS subcategories,
    count(DISTINCT CASE WHEN {_MINE} AND "L3" <> 'NA' THEN "L3" END) AS l3_values,
    count(DISTINCT CASE WHEN {_MINE} AND "L4" <> 'NA' THEN "L4" END) AS l4_values,
    round_even(sum(least(match_score, 100)) FILTER ({_MINE}) / (count(*) FILTER ({_MINE}) * 100.0::DOUBLE), 2)
    AS avg_confidence FROM res""", lambda out: R.custom_report(out, ["Billing", "Technical"], True))
for _d in (2, 3, 4):
    _keys = ", ".join(_P[:_d])
    on_orders("path_distribution" + ("" if _d == 3 else f"_l{_d}"), f"""SELECT {_keys}, count(*) AS "Count",
        {pct('count(*)', "(SELECT count(*) FROM res WHERE " + '"Category"' + " IN ('ASIA', 'EUROPE'))")} AS "Pct"
        FROM res WHERE "Category" IN ('ASIA', 'EUROPE') AND {_P[_d - 1]} <> 'NA' GROUP BY {_keys}""",
              lambda out, d=_d: R.path_distribution(R.chosen(out, ["ASIA", "EUROPE"]), d))

# --- metrics --------------------------------------------------------------------------------------------------------

_D = "CAST(price AS DECIMAL(28, 6))"
_MEAN = f"sum({_D})::DOUBLE / count(price)"
_STATS = f"""round_even({_MEAN}, 2) AS "Mean", round_even(quantile_cont(price, 0.5), 2) AS "Median",
    round_even(sum({_D})::DOUBLE, 2) AS "Sum", round_even(min(price), 2) AS "Min", round_even(max(price), 2) AS "Max",
    count(price) AS "Count", round_even(stddev_samp(price), 2) AS "StdDev" """
on_orders("metric_by_group", f"""SELECT "Subcategory", {_STATS} FROM res WHERE {_NAMED.format(c='Subcategory')}
    GROUP BY 1""", lambda out: R.metric_stats(out, "Subcategory", "price_text"))
on_orders("metric_overall", f"""SELECT {_STATS}, count(DISTINCT "Category") AS "Groups" FROM res
    WHERE {_NAMED.format(c='Category')}""", lambda out: R.metric_overall(out, "Category", "price"))
on_orders("metric_box_stats", f"""SELECT "Subcategory", round_even({_MEAN}, 2) AS "Mean",
    round_even(stddev_samp(price), 2) AS "StdDev", round_even(quantile_cont(price, 0.25), 4) AS "Q1",
    round_even(quantile_cont(price, 0.5), 4) AS "Median", round_even(quantile_cont(price, 0.75), 4) AS "Q3" FROM res
    WHERE {_NAMED.format(c='Subcategory')} GROUP BY 1 ORDER BY {_MEAN} DESC, 1 LIMIT 12""",
          lambda out: R.box_stats(out, "Subcategory", "price"))
_BAL = "round_even(sum(CAST(balance AS DECIMAL(28, 6)))::DOUBLE / count(balance), 2)"
on_orders("metric_combo", f"""SELECT "Subcategory", count(price) AS "Count", round_even(max(price), 2) AS price,
    round_even(max(balance), 2) AS balance FROM res WHERE {_NAMED.format(c='Subcategory')} GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 15""", lambda out: R.metric_combo(out, "Subcategory", ["price", "balance"], "Max"))
on_orders("metric_means_top", f"""SELECT "L3", count(price) AS "Count", round_even({_MEAN}, 2) AS price, {_BAL} AS balance
    FROM res WHERE {_NAMED.format(c='L3')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
          lambda out: R.metric_means_top(out, "L3", ["price", "balance"]))
_EXT = """SELECT '{m}' AS metric, round_even(o, 2) AS overall_mean, arg_max(g, v) AS highest, round_even(max(v), 2) AS highest_mean,
    arg_min(g, v) AS lowest, round_even(min(v), 2) AS lowest_mean, CASE WHEN (max(v) - min(v)) / o > 0.5 THEN 'significant'
    WHEN (max(v) - min(v)) / o > 0.2 THEN 'moderate' ELSE 'consistent' END AS spread FROM
    (SELECT "Category" AS g, sum(CAST({m} AS DECIMAL(28, 6)))::DOUBLE / count(*) AS v FROM res
     WHERE "Category" NOT IN ('NA', 'Uncategorized') GROUP BY 1),
    (SELECT sum(CAST({m} AS DECIMAL(28, 6)))::DOUBLE / count(*) AS o FROM res) GROUP BY o"""
on_orders("metric_extremes", _EXT.format(m="price") + " UNION ALL " + _EXT.format(m="balance"),
          lambda out: R.metric_extremes(out, "Category", ["price", "balance"]))

# --- time -----------------------------------------------------------------------------------------------------------

_PERIOD = {"day": "strftime(order_date, '%Y-%m-%d')", "month": "strftime(order_date, '%Y-%m')",
           "week": "strftime(date_trunc('week', order_date), '%Y-%m-%d') || '/' || "
                   "strftime(date_trunc('week', order_date) + INTERVAL 6 DAY, '%Y-%m-%d')"}
for _p in ("day", "week", "month"):
    on_orders("metric_trend" + ("" if _p == "month" else f"_{_p}"), f"""SELECT {_PERIOD[_p]} AS "Period",
        {_MEAN} AS "Value" FROM res WHERE {_NAMED.format(c='Category')} GROUP BY 1""",
              lambda out, p=_p: R.metric_trend(out, "Category", "order_date", "price", p))
on_orders("metric_trend_by_group", f"""SELECT {_PERIOD['month']} AS "Period", "Subcategory",
    sum({_D})::DOUBLE AS "Value" FROM res WHERE "Subcategory" IN (SELECT "Subcategory" FROM res
      WHERE {_NAMED.format(c='Subcategory')} GROUP BY 1 ORDER BY sum({_D}) DESC, 1 LIMIT 5) GROUP BY 1, 2""",
          lambda out: R.metric_trend_by_group(out, "Subcategory", "order_date", "price", "month", "Sum"))
on_orders("category_trend", f"""SELECT {_PERIOD['week']} AS "Period", "Subcategory", count(*) AS "Count" FROM res
    WHERE "Subcategory" IN (SELECT "Subcategory" FROM res WHERE {_NAMED.format(c='Subcategory')} GROUP BY 1
      ORDER BY count(*) DESC, 1 LIMIT 7) GROUP BY 1, 2""",
          lambda out: R.category_trend(out, "order_date", "Subcategory", "week", 7))
on_orders("median_split_date", """SELECT CAST(order_date AS DATE) AS split_date FROM
    (SELECT order_date, row_number() OVER (ORDER BY order_date) AS i, count(*) OVER () AS n FROM res)
    WHERE i = floor(n / 2) + 1""", lambda out: R.split_date(out, "order_date"))
_CHG = f"""m AS (SELECT *, "Period_2" - "Period_1" AS "Change", round_even(("Period_2" - "Period_1") * 100.0::DOUBLE
      / CASE WHEN "Period_1" = 0 THEN 1 ELSE "Period_1" END, 1) AS "ChangePct" FROM
    (SELECT "Subcategory", count(*) FILTER (order_date < TIMESTAMP '1998-06-01') AS "Period_1",
      count(*) FILTER (order_date >= TIMESTAMP '1998-06-01') AS "Period_2" FROM res
     WHERE {_NAMED.format(c='Subcategory')} GROUP BY 1))"""
query("top_movers", f"""{ORES}, {_CHG} SELECT *, 'gain' AS "Side" FROM (SELECT * FROM m ORDER BY "Change" DESC, "Subcategory"
    LIMIT 10) UNION ALL SELECT *, 'loss' FROM (SELECT * FROM m ORDER BY "Change", "Subcategory" DESC LIMIT 10)""")(
    lambda spark, sf: R.top_movers(order_results(spark, sf), "order_date", "Subcategory", "1998-06-01"))

# --- narrative ------------------------------------------------------------------------------------------------------

_FACTS = """f AS (SELECT count(*) AS n, count(*) FILTER ("Category" <> 'Uncategorized') AS c,
      count(DISTINCT "Category") FILTER ("Category" <> 'Uncategorized') AS k,
      sum(least(match_score, 100))::DOUBLE / (count(*) * 100.0::DOUBLE) AS conf,
      count(*) FILTER (match_score < 30) AS low FROM res),
    t AS (SELECT "Category" AS g, count(*) AS m FROM res WHERE "Category" <> 'Uncategorized' GROUP BY 1
      ORDER BY 2 DESC, 1 LIMIT 3)"""
query("narrative_facts", f"""{RES}, {_FACTS} SELECT n AS records, c AS categorized, n - c AS uncategorized,
    k AS categories, round_even(c * 100.0::DOUBLE / n, 1) AS coverage_pct,
    CASE WHEN c * 100.0 / n > 90 THEN 'excellent' WHEN c * 100.0 / n > 75 THEN 'good' WHEN c * 100.0 / n > 50
      THEN 'moderate' ELSE 'low' END AS coverage_verdict,
    (SELECT g FROM t ORDER BY m DESC, g LIMIT 1) AS top_category,
    round_even((SELECT max(m) FROM t) * 100.0::DOUBLE / n, 1) AS top_category_pct,
    round_even((SELECT sum(m) FROM t) * 100.0::DOUBLE / n, 1) AS top3_pct,
    (SELECT "Subcategory" FROM res WHERE "Subcategory" <> 'NA' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_sub,
    round_even(conf, 2) AS avg_confidence,
    CASE WHEN conf > 0.7 THEN 'high' WHEN conf > 0.4 THEN 'moderate' ELSE 'low' END AS confidence_verdict,
    round_even(low * 100.0::DOUBLE / n, 1) AS low_confidence_pct FROM f""")(
    lambda spark, sf: R.narrative_facts(results(spark, sf)))
query("recommendations", f"""{RES}, {_FACTS}, x AS (SELECT 'low_coverage' AS r FROM f WHERE c * 100.0 / n < 80
    UNION ALL SELECT 'low_confidence' FROM f WHERE low * 100.0 / n > 20
    UNION ALL SELECT 'many_uncategorized' FROM f WHERE n - c > n * 0.15
    UNION ALL SELECT 'dominant_category' FROM f WHERE (SELECT max(m) FROM t) / n > 0.3)
    SELECT r AS recommendation FROM x UNION ALL SELECT 'all_good' WHERE NOT EXISTS (SELECT * FROM x)""")(
    lambda spark, sf: R.recommendations(results(spark, sf)))

# --- other distributions --------------------------------------------------------------------------------------------


@query("sentiment_distribution", f"""WITH {sentiment_sql()}, b AS (SELECT {BANDS} AS sentiment, polarity FROM sen)
    SELECT sentiment, count(*) AS "Count", round_even(avg(CAST(polarity AS DECIMAL(18, 9)))::DOUBLE, 6) AS "AvgScore",
    {pct('count(*)', '(SELECT count(*) FROM b)')} AS "Pct" FROM b GROUP BY 1""")
def _(spark, sf):
    out = sentiment_bands(docs(spark, sf), "text", lexicons(spark, sf)[0])
    return R.sentiment_dist(out, "sentiment", "sentiment_score")


@query("sentiment_distribution_hybrid", f"""WITH {sentiment_sql()}, b AS (SELECT {HYBRID} AS sentiment FROM sen)
    SELECT sentiment, count(*) AS "Count", {pct('count(*)', '(SELECT count(*) FROM b)')} AS "Pct" FROM b GROUP BY 1""")
def _(spark, sf):
    return R.sentiment_dist(sentiment_hybrid(docs(spark, sf), "text", *lexicons(spark, sf)))


@query("proximity_distribution", f"""WITH {theme_sql()} SELECT primary_proximity, count(*) AS "Count" FROM th
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return R.theme_dist(proximity_themes(docs(spark, sf), "text"))


@query("language_share", f"""WITH l AS ({language_sql()}) SELECT CASE WHEN language = 'en' THEN 'English' ELSE 'Foreign' END
    AS kind, count(*) AS "Count", {pct('count(*)', '(SELECT count(*) FROM l)')} AS "Pct" FROM l GROUP BY 1""")
def _(spark, sf):
    return R.language_share(with_language(docs(spark, sf), "text"))


on_docs("analytics_sql", """SELECT 'l1' AS kind, "Category" AS name, count(*) AS n FROM res GROUP BY 2
    UNION ALL SELECT 'total', 'total_records', count(*) FROM res
    UNION ALL SELECT 'total', 'unique_l1_categories', count(DISTINCT "Category") FROM res
    UNION ALL SELECT 'total', 'unique_l2_categories', count(DISTINCT "Subcategory") FROM res""", R.analytics_sql)
on_docs("category_filter_counts", f"""SELECT rule AS "Category", count(*) AS "Count",
    {pct('count(*)', '(SELECT count(*) FROM res)')} AS "Pct" FROM (SELECT matched_rule AS rule FROM res)
    WHERE rule <> '' GROUP BY 1""",
        lambda out: R.level_table(out.select(F.col("matched_rule").alias("Category")), "Category", blank=""))
