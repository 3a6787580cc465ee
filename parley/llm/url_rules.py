"""URL filters: fixed host and path rules, and association rules on URL tokens mined by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule -> verdict. A rule is a host, which stands for its subdomains too, and the start of a path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SUPPORT = 0.01
CONFIDENCE = 0.8
DEFAULT = "allow"
_MARK = "verdict="


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = _rest(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def tokens_of(url: Column) -> Column:
    """Different tokens of a URL: labels of the host, parts of the path with digits as ``#``, names of parameters,
    and that there is a fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, r"/"), lambda x: x != ""),
                        lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "#")))
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                        lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^[^=]*", 0)))
    fragment = F.when(F.contains(_rest(url), F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(labels, parts, names, fragment)
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def fixed_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the given rules that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Association rules ``tokens`` (array), ``verdict``, ``confidence``, ``support`` from rows of ``tokens`` and
    ``verdict``, by FP-growth.

    A rule is pruned if a rule with a part of its tokens says the same at least as surely. Their number is bounded by
    the support, not by the data.
    """
    items = labelled.where(F.col("verdict").isNotNull()).select(
        F.array_union("tokens", F.array(F.concat(F.lit(_MARK), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = (model.associationRules.where(F.startswith(F.element_at("consequent", 1), F.lit(_MARK)))
             .select(F.array_sort("antecedent").alias("tokens"),
                     F.substring(F.element_at("consequent", 1), len(_MARK) + 1, 1000).alias("verdict"),
                     "confidence", "support"))
    less = F.transform("r.tokens", lambda t: F.array_except("r.tokens", F.array(t)))
    smaller = (found.alias("r").select("r.tokens", "r.verdict", "r.confidence", F.explode(less).alias("part"))
               .join(found.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("sure")),
                     ["part", "verdict"]).where(F.col("sure") >= F.col("confidence")).select("tokens", "verdict").distinct())
    return found.join(smaller, ["tokens", "verdict"], "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each token set (``tokens``) that holds all tokens of some rule, the ``verdict`` of the surest such rule.

    Rules are held as an inverted index, token to rule; a rule matches where as many of its tokens are met as it has.
    Among equally sure rules the one of higher support wins, then the longer, then ``block``.
    """
    index = (rules.select(F.xxhash64("tokens", "verdict").alias("rule"), "verdict", "confidence", "support",
                          F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
    met = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
           .groupBy("tokens", "rule", "verdict", "confidence", "support", "n").agg(F.count(F.lit(1)).alias("k"))
           .where(F.col("k") == F.col("n")))
    best = F.max(F.struct("confidence", "support", "n", "verdict")).alias("best")
    return met.groupBy("tokens").agg(best).select("tokens", F.col("best.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None,
               support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (the given rule that decides, else null) and ``verdict``.

    Pages that a given rule decides are the labelled ones. FP-growth finds combinations of URL tokens that go with
    a verdict there; pages without a given rule get the verdict of the surest mined rule, or ``default``.
    Mining reads one row per labelled page; matching works on different token sets, so a host that holds a third of
    all pages is matched as often as it has different sets.

    Null URLs and those without ``://`` have an empty host and path, no tokens and the default verdict. Repeated rows
    and ids each keep their row. No labelled page means no mined rule. An empty table gives an empty table. Other
    columns do not matter. A given rule fits only if the path starts with the rule's, which begins with ``/``.
    """
    rules = RULES if rules is None else rules
    url = F.col("_url")
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"))
    rows = rows.select("_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rule = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule)
    verdict = F.lit(None).cast("string")
    for name, what in rules.items():
        verdict = F.when(F.col("rule") == name, what).otherwise(verdict)
    rows = rows.withColumn("verdict", verdict)
    mined = mine(rows, support, confidence)
    sets = rows.where(F.col("rule").isNull()).select("tokens").distinct()
    said = match(sets, mined).withColumnRenamed("verdict", "_mined")
    return (rows.join(said, "tokens", "left")
            .select(F.col("_id").alias(id_col), "host", "path", "rule",
                    F.coalesce("verdict", "_mined", F.lit(default)).alias("verdict")))
