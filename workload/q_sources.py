"""Sources, sinks and output shapes."""

from pyspark.sql import functions as F

from parley.fixed_values import COMPANY_HINTS, ID_HINTS
from parley.operators.matching import classify
from parley.operators.profiling import (
    column_profile,
    infer_column_roles,
    infer_measure_columns,
    merged_profile,
    profile_sketches,
    validate_input,
)
from parley.operators.rules import pack_rules
from parley.operators.shaping import (
    dedupe_columns,
    export_projection,
    limit_scope,
    passthrough_result,
    project_core,
    sanitize_text,
)
from parley.session import new_path
from parley.sources.packs import (
    company_rows,
    load_packs,
    load_packs_merged,
    pack_inventory,
    register_company,
)
from parley.sources.tables import land, read_csv_unique_names, read_table, write_table
from workload import sql as S
from workload.data import docs, results, table
from workload.seed import SEED_RULES

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def _folder(spark, ext):
    return f"{new_path(spark, 'scan')}.{ext}"


CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_SQL = "SELECT CAST(c_custkey AS BIGINT) c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("scan_csv", CUSTOMER_SQL)
def _(spark, sf):
    path = write_table(table(spark, sf, "customer"), "csv", _folder(spark, "csv"))
    return read_table(spark, path).select(F.col("c_custkey").cast("bigint"), *CUSTOMER_COLS[1:])


@query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def _(spark, sf):
    return (read_table(spark, f"{sf}/orders.parquet").where("o_totalprice > 300000")
            .select("o_orderkey", "o_totalprice"))


@query("scan_json", CUSTOMER_SQL)
def _(spark, sf):
    path = write_table(table(spark, sf, "customer"), "json", _folder(spark, "ndjson"))
    return read_table(spark, path, schema=CUSTOMER_SCHEMA)


@query("scan_by_extension", """SELECT 'csv' AS fmt, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier
    UNION ALL SELECT 'parquet', count(*), sum(s_suppkey)::BIGINT FROM supplier
    UNION ALL SELECT 'ndjson', count(*), sum(s_suppkey)::BIGINT FROM supplier""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    out = None
    for fmt, ext in (("csv", "csv"), ("parquet", "parquet"), ("json", "ndjson")):
        one = read_table(spark, write_table(s, fmt, _folder(spark, ext))).agg(
            F.lit(ext).alias("fmt"), F.count("*").alias("n"), F.sum(F.col("s_suppkey").cast("bigint")).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


@query("dedupe_columns", """SELECT c_custkey AS key, c_name AS name, n_nationkey AS key_1, n_name AS name_1,
    r_regionkey AS key_2, r_name AS name_2 FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return dedupe_columns(j.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                   F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"),
                                   F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("dedupe_csv_header", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS id_1 FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    # Four text files of rows dealt by key, each with the header in front.
    header = spark.range(4).select(F.col("id").alias("p"), F.lit(0).alias("o"), F.lit("id,name,id").alias("value"))
    lines = header.unionByName(s.select(F.pmod("s_suppkey", F.lit(4)).cast("bigint").alias("p"), F.lit(1).alias("o"), F.concat_ws(
        ",", F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), "s_name", F.lit('"')),
        F.col("s_acctbal").cast("string")).alias("value")))
    path = _folder(spark, "csv")
    lines.repartition("p").sortWithinPartitions("p", "o").select("p", "value").write.partitionBy("p").text(path)
    return read_csv_unique_names(spark, f"{path}/*").select(F.col("id").cast("bigint"), "name", F.col("id_1").cast("double"))


@query("limit_scope", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, sf):
    return limit_scope(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 100)


@query("validate_input", """WITH t AS (SELECT count(*) n, count(*) FILTER (text IS NULL) nulls FROM documents),
    f AS (SELECT avg(length(text)) chars FROM documents)
    SELECT 'columns_present' AS "check", true AS ok, 0.0::DOUBLE AS value
    UNION ALL SELECT 'not_empty', n > 0, n FROM t UNION ALL SELECT 'row_limit', n <= 50000, n FROM t
    UNION ALL SELECT 'not_all_null', nulls < n, nulls FROM t
    UNION ALL SELECT 'mostly_filled', nulls <= n * 0.5, nulls FROM t
    UNION ALL SELECT 'long_enough', chars >= 10, chars FROM f""")
def _(spark, sf):
    return validate_input(table(spark, sf, "documents"), ["doc_id", "text"], "text")


def _profile_sql(col, kind, src):
    text = kind == "text"
    return (f"SELECT '{col}' AS \"column\", '{kind}' AS type, count({col}) AS non_null, "
            f"count({col}) * 100.0::DOUBLE / count(*) AS non_null_pct, count(DISTINCT {col}) AS \"distinct\", "
            f"count(*) - count({col}) AS missing, "
            + (f"sum(length({col}))::DOUBLE / count({col})" if text else "NULL::DOUBLE") + " AS avg_len, "
            + (f"min(length({col}))::INT" if text else "NULL::INT") + " AS min_len, "
            + (f"max(length({col}))::INT" if text else "NULL::INT") + f" AS max_len, count(*) AS rows FROM {src}")


@query("column_profile", " UNION ALL ".join(_profile_sql(c, k, "documents") for c, k in (
    ("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number"))))
def _(spark, sf):
    return column_profile(table(spark, sf, "documents"))


# Profiles of two parts of the orders, united from their sketches; estimates are held to five percent.
@query("profile_of_parts", """SELECT 'o_orderkey' AS "column", count(*) AS rows, count(o_orderkey) AS non_null, true AS near_distinct
    FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(o_orderstatus), true FROM orders
    UNION ALL SELECT 'o_custkey', count(*), count(o_custkey), true FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    parts = profile_sketches(o.where("o_orderstatus = 'O'")).unionByName(profile_sketches(o.where("o_orderstatus <> 'O'")))
    known = column_profile(o).select("column", F.col("distinct").alias("d"))
    near = F.abs(F.col("distinct") - F.col("d")) <= F.col("d") * 0.05
    return merged_profile(parts).join(known, "column").select("column", "rows", "non_null", near.alias("near_distinct"))


def _roles_sql():
    cols = [("c_custkey", False), ("c_name", True), ("c_nationkey", False), ("c_acctbal", False),
            ("c_mktsegment", True), ("note", True)]
    src = "(SELECT *, 'Customer of segment ' || c_mktsegment || ' with balance ' || c_custkey AS note FROM customer)"
    parts = []
    for c, is_text in cols:
        named = "true" if any(h in c for h in ID_HINTS) else f"count(DISTINCT {c})::DOUBLE / count(*) > 0.8"
        long = f"avg(length({c})) > 30" if is_text else "false"
        comp = "true" if any(h in c for h in COMPANY_HINTS) else "false"
        parts.append(f"SELECT col AS \"column\", i AS id_like, t AS text_like, co AND NOT i AND NOT t AS company_like "
                     f"FROM (SELECT '{c}' AS col, {named} AS i, {long} AS t, {comp} AS co FROM {src})")
    return " UNION ALL ".join(parts)


@query("infer_column_roles", _roles_sql())
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn(
        "note", F.concat(F.lit("Customer of segment "), "c_mktsegment", F.lit(" with balance "),
                         F.col("c_custkey").cast("string")))
    return infer_column_roles(c)


@query("infer_measure_columns", """SELECT * FROM (VALUES ('o_orderkey', true, false), ('o_custkey', true, false),
    ('o_orderstatus', false, false), ('o_totalprice', true, false), ('o_orderdate', false, true),
    ('o_orderpriority', false, false)) v("column", numeric, date)
    UNION ALL SELECT 'price_text', count(try_cast(CAST(o_totalprice AS VARCHAR) AS DOUBLE)) > count(*) * 0.3, false
      FROM orders
    UNION ALL SELECT 'date_text', false, bool_and(try_cast(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) IS NOT NULL)
      FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return infer_measure_columns(o.withColumns({
        "price_text": F.col("o_totalprice").cast("string"),
        "date_text": F.date_format("o_orderdate", "yyyy-MM-dd")}))


# --- packs: one rule group per supplier, one keyword group per customer, industries are the regions ------------------

def _pack_docs(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")

    def entries(t, key, name, nation, kind):
        t = table(spark, sf, t)
        j = t.join(places, t[nation] == places.n_nationkey)
        conditions = F.array(F.lower(name), F.concat(F.lower(name), F.lit(" desk")))
        levels = F.struct(F.col("r_name").alias("category"), F.col("n_name").alias("subcategory"),
                          F.when(F.col(key) > 50, F.lit("High")).alias("level_3"), F.lit("neutral").alias("sentiment"))
        return j.select(F.col("r_name").alias("industry"), F.lit(kind).alias("kind"), F.col(key).alias("group_no"),
                        conditions.alias("conditions"), levels.alias("set"))

    return entries("supplier", "s_suppkey", "s_name", "s_nationkey", "rules").unionByName(
        entries("customer", "c_custkey", "c_name", "c_nationkey", "keywords"))


def _write_packs(spark, sf, drop="", bad=""):
    """Pack folders with one document per line; AMERICA may lose a file, ASIA may get a broken line."""
    d = _pack_docs(spark, sf)
    lines = d.select("industry", F.concat("kind", F.lit(".json")).alias("kind"),
                     F.to_json(F.struct("conditions", "set")).alias("value"))
    if drop:
        lines = lines.where(~((F.col("industry") == drop) & (F.col("kind") == "keywords.json")))
    if bad:
        broken = spark.range(1).select(F.lit(bad).alias("industry"), F.lit("rules.json").alias("kind"),
                                       F.lit('{"conditions": ["x"').alias("value"))
        lines = lines.unionByName(broken)
    path = new_path(spark, "packs")
    lines.repartition("industry", "kind").write.partitionBy("industry", "kind").text(path)
    return path


_PLACES = "nation JOIN region ON n_regionkey = r_regionkey"
_PACKS = f"""g AS (SELECT r_name AS industry, 'rules' AS kind, s_suppkey AS no, lower(s_name) AS nm, n_name,
      s_suppkey > 50 AS hi FROM supplier JOIN {_PLACES} ON s_nationkey = n_nationkey
    UNION ALL SELECT r_name, 'keywords', c_custkey, lower(c_name), n_name, c_custkey > 50
      FROM customer JOIN {_PLACES} ON c_nationkey = n_nationkey)""".replace(
          f"JOIN {_PLACES} ON", f"JOIN ({'SELECT * FROM ' + _PLACES}) ON")
_PACK_COLS = """industry, kind, nm || '|' || nm || ' desk' AS conditions, industry AS l1, n_name AS l2,
    CASE WHEN hi THEN 'High' ELSE 'NA' END AS l3, 'NA' AS l4, 'neutral' AS sentiment"""


def _flat(groups):
    return groups.select("industry", "kind", F.array_join("conditions", "|").alias("conditions"), "l1", "l2", "l3",
                         "l4", "sentiment")


@query("load_packs", f"WITH {_PACKS} SELECT {_PACK_COLS} FROM g WHERE industry <> 'AMERICA'")
def _(spark, sf):
    return _flat(load_packs(spark, _write_packs(spark, sf, drop="AMERICA"), multiline=False))


@query("load_packs_merged", f"""WITH {_PACKS} SELECT CASE WHEN industry = 'EUROPE' THEN 'Other' ELSE industry END
    AS industry, kind, nm || '|' || nm || ' desk' AS conditions, industry AS l1, n_name AS l2,
    CASE WHEN hi THEN 'High' ELSE 'NA' END AS l3, 'NA' AS l4, 'neutral' AS sentiment FROM g""")
def _(spark, sf):
    d = _pack_docs(spark, sf).withColumn("domain", F.when(F.col("industry") != "EUROPE", F.col("industry")))
    paths = [write_table(d.where(F.col("kind") == k).select("conditions", "set", "domain"), "json",
                         new_path(spark, k)) for k in ("rules", "keywords")]
    return _flat(load_packs_merged(spark, *paths, multiline=False))


@query("pack_inventory", f"""WITH {_PACKS}, c AS (SELECT industry, count(*) FILTER (kind = 'rules') AS rules,
      count(*) FILTER (kind = 'keywords' AND industry <> 'AMERICA') AS keywords FROM g GROUP BY 1),
    e AS (SELECT r_name AS industry FROM region WHERE r_name <> 'AFRICA' UNION ALL SELECT 'Healthcare')
    SELECT industry, e.industry IS NOT NULL AS expected, coalesce(rules, 0) AS rules,
      coalesce(keywords, 0) AS keywords, CASE WHEN industry = 'ASIA' THEN 'invalid'
      WHEN rules IS NULL OR industry = 'AMERICA' THEN 'missing' ELSE 'valid' END AS status
    FROM c FULL JOIN e USING (industry)""")
def _(spark, sf):
    path = _write_packs(spark, sf, drop="AMERICA", bad="ASIA")
    names = table(spark, sf, "region").where("r_name <> 'AFRICA'").select(F.col("r_name").alias("industry"))
    expected = names.unionByName(spark.range(1).select(F.lit("Healthcare").alias("industry")))
    return pack_inventory(spark, path, expected, multiline=False)


@query("explode_pack_rules", f"""WITH {_PACKS}, c AS (SELECT *, unnest([nm, nm || ' desk']) AS cond,
      unnest([0, 1]) AS cno FROM g)
    SELECT upper(substr(industry, 1, 3)) || '-' || printf('%04d', ord) AS rule_id, cond AS term, industry AS l1,
      n_name AS l2, CASE WHEN hi THEN 'High' ELSE 'NA' END AS l3, 'json' AS source, ord AS ordinal FROM
    (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY kind DESC, no, cno) AS ord FROM c)""")
def _(spark, sf):
    d = _pack_docs(spark, sf)
    groups = d.select("industry", "kind", "group_no", "conditions", F.col("set.category").alias("l1"),
                      F.col("set.subcategory").alias("l2"), F.coalesce("set.level_3", F.lit("NA")).alias("l3"),
                      F.lit("NA").alias("l4"), F.col("set.sentiment").alias("sentiment"))
    return pack_rules(groups).select("rule_id", F.get("terms", F.lit(0)).alias("term"), "l1", "l2", "l3", "source",
                                     "ordinal")


def _company_docs(spark, sf):
    """One small company map per supplier."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    return j.select(F.to_json(F.struct(F.lit("1.0").alias("version"), F.create_map(
        "n_name", F.array("s_name", F.concat("s_name", F.lit(" Ltd")))).alias("industries"))).alias("value"))


@query("load_company_map", """SELECT n_name AS industry, unnest([s_name, s_name || ' Ltd']) AS company,
    unnest([0, 1]) AS company_no FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, sf):
    path = new_path(spark, "companies")
    _company_docs(spark, sf).write.text(path)
    return company_rows(spark.read.text(path)).select("industry", "company", "company_no")


@query("register_company", """SELECT n_name AS industry, unnest([s_name, s_name || ' Ltd']) AS company
      FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    known = company_rows(_company_docs(spark, sf)).select("industry", "company")
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    new = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("industry"), F.concat(F.lit(" "), "c_name").alias("company"))
    return register_company(known, new.unionByName(known))


# --- sinks and shapes -----------------------------------------------------------------------------------------------

@query("sink_csv", "SELECT doc_id, text, lang FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = write_table(d, "csv", _folder(spark, "csv"))
    return read_table(spark, path, schema=d.schema)


@query("sink_parquet", "SELECT doc_id, text, lang FROM documents")
def _(spark, sf):
    return land(table(spark, sf, "documents").select("doc_id", "text", "lang"), _folder(spark, "parquet"))


@query("sink_ndjson", "SELECT doc_id, text, lang FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return read_table(spark, write_table(d, "json", _folder(spark, "ndjson")), schema=d.schema)


_CLEAN = "substr(regexp_replace({c}, '\\r\\n|\\r|\\n', ' | ', 'g'), 1, 5000)"


@query("sanitize_text", f"""SELECT doc_id, replace({_CLEAN.format(c='text')}, '"', '''') AS text,
    replace({_CLEAN.format(c='source')}, '"', '''') AS source FROM documents""")
def _(spark, sf):
    return sanitize_text(docs(spark, sf).select("doc_id", "text", "source"), "csv", max_chars=5_000)


_RES = f"WITH {S.classified(SEED_RULES, extra=', lang, source, n_chars')}"


@query("project_result_6col", f"""{_RES} SELECT doc_id AS "Conversation_ID", text AS "Original_Text", "Category",
    "Subcategory", "L3", "L4" FROM res""")
def _(spark, sf):
    return project_core(classify(docs(spark, sf), SEED_RULES, "text"), "doc_id", "text")


@query("passthrough_result", f"""{_RES} SELECT doc_id AS "Conversation_ID", text AS "Original_Text", lang, source,
    n_chars, "Category", "Subcategory", "L3", "L4", confidence, matched_rule, match_score, match_detail FROM res""")
def _(spark, sf):
    return results(spark, sf)


@query("export_projection", f"""{_RES} SELECT doc_id AS "Conversation_ID", text AS "Original_Text", "Category",
    "Subcategory", "L3", "L4", confidence, matched_rule FROM res""")
def _(spark, sf):
    return export_projection(results(spark, sf))
