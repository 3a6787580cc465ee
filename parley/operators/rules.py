"""Rules as a table: parsing, packs, scores, ranks, conflicts.

Columns of a rule table: rule_id, terms, operators, proximity, position, within_words, sent_by, exclude_if,
l1..l4, source, sentiment, ordinal. ``ordinal`` is the input order and decides ties.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.fixed_values import NOT_AVAILABLE, UNCATEGORIZED
from parley.functions.once import once
from parley.functions.text import strip, words
from parley.operators.ordering import running_total

RULE_JSON = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("terms", T.ArrayType(T.StringType())),
    T.StructField("operators", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.StringType()) for n in ("term1", "term2", "term3", "operator1", "operator2")],
    T.StructField("proximity", T.IntegerType()),
    T.StructField("position", T.StringType()),
    T.StructField("within_words", T.IntegerType()),
    T.StructField("sent_by", T.StringType()),
    T.StructField("exclude_if", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.StringType()) for n in ("l1", "l2", "l3", "l4", "source", "sentiment")],
])

RULE_COLUMNS = ["rule_id", "terms", "operators", "proximity", "position", "within_words", "sent_by", "exclude_if",
                "l1", "l2", "l3", "l4", "source", "sentiment", "ordinal"]


def _strings(col):
    return F.coalesce(col, F.array().cast("array<string>"))


def _not_blank(terms):
    """Terms which are not blank, with their places."""
    return F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
                    lambda s: strip(F.coalesce(s["t"], F.lit(""))) != "")


def _operators_of(kept, operators):
    """A blank term goes together with the operator in front of it (the first term has none)."""
    later = F.when(F.size(kept) > 1, F.slice(kept, 2, F.size(kept))).otherwise(F.slice(kept, 1, 0))
    return F.filter(F.transform(later, lambda s: F.get(operators, s["i"] - 1)), lambda o: o.isNotNull())


def parse_rules(docs: DataFrame, json_col: str = "value", ordinal_col: str | None = None) -> DataFrame:
    """JSON documents to rule rows; the older form with term1..term3 and operator1..operator2 is read as well."""
    ordinal = F.col(ordinal_col) if ordinal_col else F.monotonically_increasing_id()
    d = docs.select(once(F.from_json(json_col, RULE_JSON)).alias("r"), ordinal.cast("long").alias("ordinal"))
    r = F.col("r")
    d = d.withColumn("kept", once(_not_blank(_strings(r["terms"]))))

    def filled(names, no=()):
        vals = F.transform(F.array(*[r[n] for n in names]), lambda v: strip(F.coalesce(v, F.lit(""))))
        return F.filter(vals, lambda v: (v != "") & ~v.isin([*no, "\0"]))

    old_terms = filled(("term1", "term2", "term3"))
    old_ops = filled(("operator1", "operator2"), no=("None",))
    new_terms = F.transform("kept", lambda s: s["t"])
    new_ops = _operators_of(F.col("kept"), _strings(r["operators"]))
    is_new = r["terms"].isNotNull()
    return d.select(
        F.coalesce(r["rule_id"], F.lit("")).alias("rule_id"),
        F.when(is_new, new_terms).otherwise(old_terms).alias("terms"),
        F.when(is_new, new_ops).otherwise(old_ops).alias("operators"),
        r["proximity"].alias("proximity"), r["position"].alias("position"),
        F.coalesce(r["within_words"], F.lit(50)).alias("within_words"), r["sent_by"].alias("sent_by"),
        _strings(r["exclude_if"]).alias("exclude_if"),
        F.coalesce(r["l1"], F.lit(UNCATEGORIZED)).alias("l1"),
        *[F.coalesce(r[n], F.lit(NOT_AVAILABLE)).alias(n) for n in ("l2", "l3", "l4")],
        F.coalesce(r["source"], F.lit("manual")).alias("source"), r["sentiment"].alias("sentiment"), "ordinal")


def rules_from_dicts(spark, rules: list[dict]) -> DataFrame:
    """A rule table from plain dictionaries in order of preference among equals."""
    documents = F.array(*[F.lit(json.dumps(r)) for r in rules])
    return parse_rules(spark.range(0, 1, 1, 1).select(F.posexplode(documents).alias("ordinal", "value")), "value", "ordinal")


def pack_rules(groups: DataFrame, industry: str | None = None) -> DataFrame:
    """One single-term rule per condition of a pack; rules come before keywords.

    ``groups`` as made by ``sources.packs``: industry, kind ('rules' or 'keywords'), group_no, conditions, l1..l4.
    """
    g = groups.where(F.col("industry") == industry) if industry else groups
    started = running_total(g, ["industry", "kind"], "group_no", F.size("conditions"), "start")
    ahead = (g.where(F.col("kind") == "rules").groupBy("industry")
             .agg(F.sum(F.size("conditions")).alias("n_rules")))
    numbered = started.join(ahead, "industry", "left").select(
        "*", F.posexplode("conditions").alias("cond_no", "condition"))
    no = (F.when(F.col("kind") == "keywords", F.coalesce("n_rules", F.lit(0))).otherwise(0)
          + F.col("start") + F.col("cond_no") + 1)
    empty = F.array().cast("array<string>")
    return numbered.select(
        F.concat(F.upper(F.left("industry", F.lit(3))), F.lit("-"), F.format_string("%04d", no)).alias("rule_id"),
        F.array("condition").alias("terms"), empty.alias("operators"), F.lit(None).cast("int").alias("proximity"),
        F.lit(None).cast("string").alias("position"), F.lit(50).alias("within_words"),
        F.lit(None).cast("string").alias("sent_by"), empty.alias("exclude_if"),
        "l1", "l2", "l3", "l4", F.lit("json").alias("source"), "sentiment", no.alias("ordinal"), "industry")


def rules_from_table(table: DataFrame, ordinal_col: str) -> DataFrame:
    """The editable form: terms and operators split by ``|``, exclusions by comma, 0 / ANY / Any meaning none."""
    def parts(name, sep):
        return F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), sep), strip), lambda v: v != "")

    def level(name):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(NOT_AVAILABLE)).alias(name)

    return table.select(
        F.coalesce(F.nullif(F.col("rule_id"), F.lit("")),
                   F.format_string("USR-%04d", F.col(ordinal_col).cast("long") + 1)).alias("rule_id"),
        parts("terms", r"\|").alias("terms"),
        F.transform(parts("operators", r"\|"), F.upper).alias("operators"),
        F.nullif(F.col("proximity").cast("int"), F.lit(0)).alias("proximity"),
        F.nullif(F.col("position"), F.lit("ANY")).alias("position"), F.lit(50).alias("within_words"),
        F.nullif(F.col("sent_by"), F.lit("Any")).alias("sent_by"),
        parts("exclude_if", ",").alias("exclude_if"),
        level("l1"), level("l2"), level("l3"), level("l4"), F.lit("manual").alias("source"),
        F.lit(None).cast("string").alias("sentiment"), F.col(ordinal_col).cast("long").alias("ordinal"))


def union_rules(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` before ``second``: the ordinals of the second table start behind those of the first."""
    offset = first.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("__offset"))
    shifted = second.crossJoin(offset).withColumn("ordinal", F.col("ordinal") + F.col("__offset")).drop("__offset")
    return first.select(*RULE_COLUMNS).unionByName(shifted.select(*RULE_COLUMNS))


def rule_term_patterns(rules: DataFrame) -> DataFrame:
    """One row per term with its matching pattern: trimmed, lower-cased, escaped, ``*`` for word characters."""
    term = F.lower(strip(F.col("term")))
    escaped = F.regexp_replace(term, r"([!-)+-/:-@\[-^`{-~])", r"\\$1")
    return (rules.select("rule_id", F.posexplode("terms").alias("term_no", "term"))
            .where(term != "")
            .select("rule_id", "term_no", "term",
                    F.concat(F.lit(r"(?i)\b"), F.replace(escaped, F.lit("*"), F.lit(r"\w*")), F.lit(r"\b"))
                    .alias("pattern")))


def score_rules(rules: DataFrame) -> DataFrame:
    """Add the specificity score: longer and more constrained rules score higher."""
    n_words = F.aggregate("terms", F.lit(0), lambda a, t: a + F.size(words(t)))
    ops = F.col("operators")

    def bonus(test, points):
        return F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)

    return rules.withColumn("score", F.lit(10) + n_words * 10 + bonus(F.size(ops) > 0, 10)
                            + bonus(F.array_contains(ops, "NEAR"), 15) + bonus(F.array_contains(ops, "NOT LIKE"), 5)
                            + bonus(F.col("position").isin("START", "END"), 5))


def rank_rules(scored: DataFrame) -> DataFrame:
    """Add ``rank``: 1 for the rule tried first, by falling score, equal scores in input order."""
    per_score = scored.groupBy("score").count()
    better = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # One row per distinct score: a handful of integers.
    offsets = per_score.select("score", F.coalesce(F.sum("count").over(better), F.lit(0)).alias("__better"))
    return (running_total(scored, ["score"], "ordinal", F.lit(1), "__before").join(offsets, "score")
            .withColumn("rank", F.col("__better") + F.col("__before") + 1).drop("__better", "__before"))


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Rules whose first term leads to more than one top category: one row per rule, with the sorted categories.

    Rows, not a list of ids, as a single term may be shared by any number of rules.
    """
    keyed = rules.withColumn("term", F.lower(strip(F.get("terms", F.lit(0))))).where(F.col("term") != "")
    clashing = (keyed.groupBy("term").agg(F.array_sort(F.collect_set("l1")).alias("cats"))
                .where(F.size("cats") > 1).select("term", F.array_join("cats", ", ").alias("categories")))
    return keyed.join(clashing, "term").select("term", "categories", "rule_id", "ordinal")


def rule_hierarchy(rules: DataFrame) -> DataFrame:
    """Distinct category paths; a missing level ends the path."""
    l2 = F.col("l2")
    l3 = F.when(l2 == NOT_AVAILABLE, NOT_AVAILABLE).otherwise(F.col("l3"))
    l4 = F.when((l2 == NOT_AVAILABLE) | (F.col("l3") == NOT_AVAILABLE), NOT_AVAILABLE).otherwise(F.col("l4"))
    return (rules.where(~F.col("l1").isin(NOT_AVAILABLE, UNCATEGORIZED))
            .select("l1", "l2", l3.alias("l3"), l4.alias("l4")).distinct())


def rules_to_json(rules: DataFrame) -> DataFrame:
    """One JSON document per rule."""
    cols = [c for c in RULE_COLUMNS if c not in ("ordinal", "sentiment")]
    return rules.select("rule_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
