"""The rule model. The rules are made from the parts table, one per part."""

from pyspark.sql import functions as F

from parley.operators.rules import (
    parse_rules,
    rank_rules,
    rule_conflicts,
    rule_hierarchy,
    rule_term_patterns,
    rules_from_table,
    rules_to_json,
    score_rules,
    union_rules,
)
from workload.data import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def rule_documents(spark, sf):
    """A rule per part as JSON, in the older form for promotional parts; some terms are blank."""
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    is_new = F.col("p_type") != "PROMO"
    op = (F.when(F.col("p_size") < 10, "NEAR").when(F.col("p_size") < 20, "NOT LIKE").when(F.col("p_size") < 30, "OR")
          .otherwise("AND"))
    doc = F.struct(
        F.format_string("P-%d", "p_partkey").alias("rule_id"),
        F.when(is_new, F.array(F.get(words, F.lit(0)), F.lit(" "), F.get(words, F.lit(1)))).alias("terms"),
        F.when(is_new, F.array(F.lit("AND"), op)).alias("operators"),
        F.when(~is_new, F.col("p_name")).alias("term1"), F.when(~is_new, F.lit(" ")).alias("term2"),
        F.when(~is_new, F.col("p_brand")).alias("term3"), F.when(~is_new, op).alias("operator1"),
        F.when(~is_new, F.lit("None")).alias("operator2"),
        F.when(F.col("p_size") < 10, F.col("p_size")).alias("proximity"),
        F.when(F.col("p_retailprice") > 950, F.lit("START")).alias("position"),
        F.array(F.col("p_brand")).alias("exclude_if"),
        F.col("p_type").alias("l1"), F.when(F.col("p_size") > 15, F.col("p_brand")).alias("l2"))
    return p.select(F.col("p_partkey").alias("no"), F.to_json(doc).alias("value"))


def rules(spark, sf):
    return parse_rules(rule_documents(spark, sf), "value", "no")


_OP = "CASE WHEN p_size < 10 THEN 'NEAR' WHEN p_size < 20 THEN 'NOT LIKE' WHEN p_size < 30 THEN 'OR' ELSE 'AND' END"
_RULES = f"""r AS (SELECT 'P-' || p_partkey AS rule_id,
    CASE WHEN p_type <> 'PROMO' THEN [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]
      ELSE [p_name, p_brand] END AS terms,
    CASE WHEN p_type <> 'PROMO' THEN [{_OP}] ELSE [{_OP}] END AS operators,
    CASE WHEN p_size < 10 THEN p_size END AS proximity,
    CASE WHEN p_retailprice > 950 THEN 'START' END AS position, [p_brand] AS exclude_if,
    p_type AS l1, CASE WHEN p_size > 15 THEN p_brand ELSE 'NA' END AS l2, p_partkey AS ordinal FROM part),
  sc AS (SELECT *, (10 + 10 * len(string_split(array_to_string(terms, ' '), ' ')) + 10
    + CASE WHEN operators[1] = 'NEAR' THEN 15 WHEN operators[1] = 'NOT LIKE' THEN 5 ELSE 0 END
    + CASE WHEN position IS NOT NULL THEN 5 ELSE 0 END)::INT AS score FROM r)"""


@query("parse_rules", f"""WITH {_RULES} SELECT rule_id, array_to_string(terms, '|') AS terms,
    array_to_string(operators, '|') AS operators, proximity, position, 50 AS within_words,
    array_to_string(exclude_if, '|') AS exclude_if, l1, l2, 'NA' AS l3, 'NA' AS l4, 'manual' AS source, ordinal FROM r""")
def _(spark, sf):
    flat = {c: F.array_join(c, "|") for c in ("terms", "operators", "exclude_if")}
    return rules(spark, sf).withColumns(flat).drop("sent_by", "sentiment")


@query("rule_term_patterns", f"""WITH {_RULES}, t AS (SELECT rule_id, unnest(terms) AS term, unnest([0, 1]) AS term_no FROM r)
    SELECT rule_id, term_no, lower(trim(term)) AS term,
    '(?i)\\b' || replace(regexp_replace(lower(trim(term)), '([!-)+-/:-@\\[-^`{{-~])', '\\\\\\1', 'g'), '*', '\\w*')
    || '\\b' AS pattern FROM t""")
def _(spark, sf):
    return rule_term_patterns(rules(spark, sf)).withColumn("term", F.lower(F.trim("term")))


@query("rule_scores", f"WITH {_RULES} SELECT rule_id, score FROM sc")
def _(spark, sf):
    return score_rules(rules(spark, sf)).select("rule_id", "score")


@query("rank_rules", f"""WITH {_RULES} SELECT rule_id, score, row_number() OVER (ORDER BY score DESC, ordinal) AS rank
    FROM sc""")
def _(spark, sf):
    return rank_rules(score_rules(rules(spark, sf))).select("rule_id", "score", "rank")


@query("union_rules", f"""WITH {_RULES} SELECT rule_id, l1, ordinal FROM r UNION ALL
    SELECT 'S-' || s_suppkey, s_name, s_suppkey + (SELECT max(ordinal) + 1 FROM r) FROM supplier""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    doc = F.struct(F.format_string("S-%d", "s_suppkey").alias("rule_id"), F.array("s_name").alias("terms"),
                   F.col("s_name").alias("l1"))
    second = parse_rules(s.select(F.col("s_suppkey").alias("no"), F.to_json(doc).alias("value")), "value", "no")
    return union_rules(rules(spark, sf), second).select("rule_id", "l1", "ordinal")


@query("rule_conflicts", f"""WITH {_RULES}, k AS (SELECT *, lower(trim(terms[1])) AS term FROM r),
    c AS (SELECT term, string_agg(l1, ', ' ORDER BY l1) AS categories FROM (SELECT DISTINCT term, l1 FROM k)
      GROUP BY term HAVING count(*) > 1)
    SELECT term, categories, rule_id, ordinal FROM k JOIN c USING (term)""")
def _(spark, sf):
    return rule_conflicts(rules(spark, sf))


@query("rule_hierarchy", f"WITH {_RULES} SELECT DISTINCT l1, l2, 'NA' AS l3, 'NA' AS l4 FROM r")
def _(spark, sf):
    return rule_hierarchy(rules(spark, sf))


@query("parse_rule_table", """SELECT CASE WHEN p_size > 25 THEN 'USR-' || printf('%04d', p_partkey + 1)
      ELSE 'T-' || p_partkey END AS rule_id, replace(p_name, ' ', '|') AS terms, 'NOT LIKE' AS operators,
    CASE WHEN p_size % 7 <> 0 THEN p_size % 7 END AS proximity,
    CASE WHEN p_retailprice > 950 THEN 'END' END AS position, CASE WHEN p_size > 40 THEN 'Agent' END AS sent_by,
    p_brand || '|' || p_type AS exclude_if, p_type AS l1, p_brand AS l2, 'NA' AS l3, p_partkey AS ordinal FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    form = p.select(
        "p_partkey", F.when(F.col("p_size") > 25, "").otherwise(F.format_string("T-%d", "p_partkey")).alias("rule_id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit(" | ")).alias("terms"),
        F.lit("not like").alias("operators"), (F.col("p_size") % 7).alias("proximity"),
        F.when(F.col("p_retailprice") > 950, "END").otherwise("ANY").alias("position"),
        F.when(F.col("p_size") > 40, "Agent").otherwise("Any").alias("sent_by"),
        F.concat("p_brand", F.lit(", ,"), "p_type").alias("exclude_if"), F.col("p_type").alias("l1"),
        F.col("p_brand").alias("l2"), F.lit("").alias("l3"), F.lit(None).cast("string").alias("l4"))
    flat = {c: F.array_join(c, "|") for c in ("terms", "operators", "exclude_if")}
    return rules_from_table(form, "p_partkey").withColumns(flat).drop("within_words", "l4", "source", "sentiment")


@query("rules_to_json", f"""WITH {_RULES} SELECT rule_id, array_to_string(terms, '|') AS terms, l1, l2, position FROM r""")
def _(spark, sf):
    docs = rules_to_json(rules(spark, sf))
    back = parse_rules(docs.withColumn("no", F.lit(0)), "json", "no")
    return back.select("rule_id", F.array_join("terms", "|").alias("terms"), "l1", "l2", "position")
