"""Reports over the classified table (Category, Subcategory, L3, L4, match_score, confidence, own columns).

Every report first shrinks the data to counts per category value; ranking, shares and pivots work on those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.fixed_values import NOT_AVAILABLE, UNCATEGORIZED
from parley.functions.once import once
from parley.functions.text import as_text, content_tokens, ngrams
from parley.operators.frequent import most_frequent
from parley.operators.quantiles import exact_quantiles
from parley.session import materialize

LEVELS = ["Category", "Subcategory", "L3", "L4"]


def pct(part, whole) -> Column:
    """Share in percent with one decimal, halves to even; null for an empty whole."""
    return F.bround(F.try_divide(part * 100.0, whole), 1)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _named(col: str) -> Column:
    return ~F.col(col).isin(NOT_AVAILABLE, UNCATEGORIZED)


def _with_total(counts: DataFrame, by: list[str] | None = None, count: str = "Count") -> DataFrame:
    """Add ``__total``, the sum of the counts per ``by``, or of all: one row, met by a join. The counts are one row per
    category value, and both sides read the same shuffled ones."""
    if by:
        return counts.withColumn("__total", F.sum(count).over(Window.partitionBy(*by)))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(count).alias("__total"))))


def _counted(test: Column) -> Column:
    """The test, to be made after the total is known. Made before, it would go down to the scan on one side of the
    join, and the data would have to be read, and classified, for each side."""
    return F.when(F.col("__total") > 0, test)


def _with_total_of_few(counts: DataFrame) -> DataFrame:
    """The same for counts of a fixed set of values, such as bands: a handful of rows."""
    return counts.withColumn("__total", F.sum("Count").over(Window.partitionBy(F.lit(1))))


# --- counts and shares ----------------------------------------------------------------------------------------------

def run_kpis(out: DataFrame) -> DataFrame:
    n, unc = F.count("*"), F.count_if(F.col("Category") == UNCATEGORIZED)
    return out.agg(n.alias("records"), *[F.count_distinct(c).alias(f"distinct_{c.lower()}") for c in LEVELS],
                   (n - unc).alias("categorized"), unc.alias("uncategorized"),
                   pct(n - unc, n).alias("categorized_pct"))


def level_table(out: DataFrame, level: str, parent: str | None = None, blank: str = NOT_AVAILABLE) -> DataFrame:
    """Count and share of all rows per value (and parent value); ``blank`` values are left out of the result only."""
    keys = [parent, level] if parent else [level]
    counts = out.groupBy(*keys).agg(F.count("*").alias("Count"))
    return (_with_total(counts).where(_counted(F.col(level) != blank))
            .withColumn("Pct", pct(F.col("Count"), F.col("__total"))).drop("__total"))


def level_table_of_parent(out: DataFrame, level: str, parents: list[str]) -> DataFrame:
    """Share of the full parent path (its rows without a value included) and of all rows."""
    counts = out.groupBy(*parents, level).agg(F.count("*").alias("Count"))
    of_parent = F.sum("Count").over(Window.partitionBy(*parents))
    return (_with_total(counts).withColumn("ParentTotal", of_parent).where(_counted(F.col(level) != NOT_AVAILABLE))
            .withColumns({"PctOfTotal": pct(F.col("Count"), F.col("__total")),
                          "PctOfParent": pct(F.col("Count"), F.col("ParentTotal"))}).drop("__total"))


def top_drivers(out: DataFrame, level: str = "Category", n: int = 15, strict: bool = True) -> DataFrame:
    """The ``n`` most frequent values without Uncategorized (or NA below the top level).

    ``strict=False`` takes the top ``n`` first and drops afterwards, so it may return fewer.
    """
    skip = UNCATEGORIZED if level == "Category" else NOT_AVAILABLE
    counts = out.groupBy(level).agg(F.count("*").alias("Count"))
    order = [F.col("Count").desc(), F.col(level)]
    if strict:
        return counts.where(F.col(level) != skip).orderBy(*order).limit(n)
    return counts.orderBy(*order).limit(n).where(F.col(level) != skip)


def cross_tab(out: DataFrame, row: str, col: str) -> DataFrame:
    return out.where(_named(row) & _named(col)).groupBy(row, col).agg(F.count("*").alias("Count"))


def heatmap(out: DataFrame, row: str, col: str, k: int = 20) -> DataFrame:
    """Counts with one column per value of ``col``, for its ``k`` most frequent values, zero where empty."""
    cells = cross_tab(out, row, col)
    top = [r[col] for r in cells.groupBy(col).agg(F.sum("Count").alias("n"))
           .orderBy(F.col("n").desc(), col).limit(k).collect()]
    return cells.groupBy(row).pivot(col, top).agg(F.sum("Count")).na.fill(0)


def decomposition_tree(out: DataFrame) -> DataFrame:
    """Nodes of the category tree: depth, path, value. Depth 0 is all rows; a missing level ends its branch."""
    leaves = out.groupBy(*LEVELS).agg(F.count("*").alias("n"))
    nodes = leaves.rollup(*LEVELS).agg(F.sum("n").alias("value"), F.grouping_id().alias("g"))
    depth = F.when(F.col("g") == 15, 0).when(F.col("g") == 7, 1).when(F.col("g") == 3, 2).when(
        F.col("g") == 1, 3).otherwise(4)
    ok = F.coalesce(_named("Category"), F.lit(True))
    for c in LEVELS[1:]:
        ok = ok & F.coalesce(F.col(c) != NOT_AVAILABLE, F.lit(True))
    return nodes.where(ok).select(depth.alias("depth"), F.concat_ws(" > ", *LEVELS).alias("path"), "value")


def min_count_filter(out: DataFrame, threshold: int | None = None) -> DataFrame:
    """Keep rows whose value is frequent enough, level after level on the rows still there."""
    if threshold is None:
        top = out.groupBy("Category").count().agg(F.max("count")).first()[0] or 0
        threshold = min(10, max(1, int(top * 0.05)))
    # The cascade runs on the counts per path; the rows are met once more, to be kept or not.
    paths = out.groupBy(*LEVELS).agg(F.count("*").alias("n"))
    for c in LEVELS:
        paths = _with_total(paths, [c], "n").where(F.col("__total") >= threshold).drop("__total")
    return out.join(paths.select(*LEVELS), LEVELS, "left_semi")


def sunburst_counts(out: DataFrame, min_share: float = 0.003) -> DataFrame:
    """Counts per full path, without tiny ones."""
    counts = out.where(_named("Category")).groupBy(*LEVELS).agg(F.count("*").alias("count"))
    return (_with_total(counts, count="count").where(F.col("count") > F.col("__total") * min_share)
            .drop("__total"))


def uncat_summary(out: DataFrame) -> DataFrame:
    n, unc = F.count("*"), F.count_if(F.col("Category") == UNCATEGORIZED)
    return out.agg(n.alias("records"), unc.alias("uncategorized"), pct(unc, n).alias("uncategorized_pct"))


def uncategorized(out: DataFrame) -> DataFrame:
    return out.where(F.col("Category") == UNCATEGORIZED)


def top_ngrams(rows: DataFrame, n: int, k: int, text_col: str = "Original_Text") -> DataFrame:
    """The ``k`` most frequent runs of ``n`` content words; ``rows`` is worked out once, and its runs are written
    to the shared folder, as ``most_frequent`` reads them twice."""
    listed = rows.select(once(content_tokens(as_text(text_col))).alias("tokens"))
    grams = listed.select(F.explode(ngrams(F.col("tokens"), n)).alias("ngram"))
    return most_frequent(materialize(grams, "ngrams"), "ngram", k).drop("place").orderBy(F.col("Count").desc(), "ngram")


def uncat_sample(out: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` uncategorized records picked by a hash of their id: random, yet the same every time."""
    lot = F.sha2(F.concat_ws(":", F.col("Conversation_ID").cast("string"), F.lit(str(seed))), 256)
    return (uncategorized(out).select("Conversation_ID", "Original_Text")
            .orderBy(lot, "Conversation_ID").limit(n))


def top5(out: DataFrame) -> DataFrame:
    """The six largest categories without Uncategorized, at most five, with their share of all rows."""
    counts = out.groupBy("Category").agg(F.count("*").alias("Count"))
    order = [F.col("Count").desc(), F.col("Category")]
    six = _with_total(counts).orderBy(*order).limit(6).where(F.col("Category") != UNCATEGORIZED)
    return (six.orderBy(*order).limit(5)
            .withColumn("Pct", pct(F.col("Count"), F.col("__total"))).drop("__total"))


def confidence_band(score: Column) -> Column:
    """Right-closed bands, decided on the whole-number score so that 0.3 and 0.7 fall on the right side."""
    return F.when(score <= 30, "Low").when(score <= 70, "Medium").otherwise("High")


def confidence_bands(out: DataFrame) -> DataFrame:
    return out.groupBy(confidence_band(F.col("match_score")).alias("Band")).agg(F.count("*").alias("Count"))


AUDIT_COLUMNS = ["Conversation_ID", "Category", "Subcategory", "L3", "L4", "confidence", "matched_rule",
                 "match_score", "match_detail"]


def audit(out: DataFrame, category: str | None = None, band: str | None = None, n: int | None = None) -> DataFrame:
    """Classification details, by category and band (High > .7, Medium .3 to .7 closed, Low < .3); all rows, or the first ``n``."""
    s = F.col("match_score")
    tests = {"High": s > 70, "Medium": (s >= 30) & (s <= 70), "Low": s < 30}
    rows = out if category is None else out.where(F.col("Category") == category)
    rows = rows if band is None else rows.where(tests[band])
    rows = rows.select(*AUDIT_COLUMNS)
    return rows if n is None else rows.orderBy("Conversation_ID").limit(n)


def chosen(out: DataFrame, categories: list[str], with_uncategorized: bool = False) -> DataFrame:
    return out.where(F.col("Category").isin(*categories, *([UNCATEGORIZED] if with_uncategorized else [])))


def custom_report(out: DataFrame, categories: list[str], with_uncategorized: bool = False) -> DataFrame:
    """Summary of the rows in the chosen categories."""
    mine = F.col("Category").isin(*categories, *([UNCATEGORIZED] if with_uncategorized else []))
    n, k = F.count("*"), F.count_if(mine)

    def kinds(c):
        return F.count_distinct(F.when(mine & (F.col(c) != NOT_AVAILABLE), F.col(c)))

    return out.agg(k.alias("records"), n.alias("all_records"), pct(k, n).alias("share_pct"),
                   F.count_distinct(F.when(mine, F.col("Category"))).alias("categories"),
                   kinds("Subcategory").alias("subcategories"), kinds("L3").alias("l3_values"),
                   kinds("L4").alias("l4_values"),
                   F.bround(F.try_divide(F.sum(F.when(mine, F.least("match_score", F.lit(100)))), k * 100.0), 2)
                   .alias("avg_confidence"))


def path_distribution(rows: DataFrame, depth: int) -> DataFrame:
    """Counts by the full path down to ``depth`` levels, rows without that level left out, share of all rows given."""
    keys = LEVELS[:depth]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("Count"))
    counts = _with_total(counts)
    kept = counts.where(_counted(F.col(keys[-1]) != NOT_AVAILABLE)) if depth > 1 else counts
    return (kept.withColumn("Pct", pct(F.col("Count"), F.col("__total")))
            .drop("__total"))


# --- metrics --------------------------------------------------------------------------------------------------------

def _metric(rows: DataFrame, metric: str) -> DataFrame:
    """Rows with a number in ``metric``, also as exact decimal, so that sums do not depend on their order."""
    v = F.col(metric).try_cast("double")
    return (rows.withColumn("__v", v).where("__v is not null")
            .withColumn("__d", F.col("__v").try_cast("decimal(28,6)")))


def _exact_mean() -> Column:
    return F.sum("__d").cast("double") / F.count("__d")


AGGREGATES = {
    "Mean": _exact_mean,
    "Sum": lambda: F.sum("__d").cast("double"),
    "Min": lambda: F.min("__v"),
    "Max": lambda: F.max("__v"),
    "Count": lambda: F.count("__v"),
    "StdDev": lambda: F.stddev_samp("__v"),
}


def _stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    plain = rows.groupBy(*keys).agg(*[(fn() if name == "Count" else F.bround(fn(), 2)).alias(name)
                                      for name, fn in AGGREGATES.items()])
    median = exact_quantiles(rows, keys, "__v", {"Median": 0.5}).withColumn("Median", F.bround("Median", 2))
    return plain.join(median, keys) if keys else plain.crossJoin(median)


def metric_stats(out: DataFrame, level: str, metric: str) -> DataFrame:
    """Mean, median, sum, min, max, count and sample deviation of a metric per value of a level, two decimals."""
    return _stats(_metric(out.where(_named(level)), metric), [level])


def metric_overall(out: DataFrame, level: str, metric: str) -> DataFrame:
    """The same figures over all rows that have a value in ``level``, and the number of its values."""
    rows = _metric(out.where(_named(level)), metric)
    return _stats(rows, []).crossJoin(rows.agg(F.count_distinct(level).alias("Groups")))


def box_stats(out: DataFrame, level: str, metric: str, n: int = 12) -> DataFrame:
    """Quartiles, mean and deviation for the ``n`` groups with the highest mean."""
    rows = _metric(out.where(_named(level)), metric)
    groups = (rows.groupBy(level).agg(_exact_mean().alias("__mean"), F.bround(F.stddev_samp("__v"), 2).alias("StdDev"))
              .orderBy(F.col("__mean").desc(), level).limit(n)
              .select(level, F.bround("__mean", 2).alias("Mean"), "StdDev"))
    quartiles = exact_quantiles(rows.join(groups.select(level), level, "left_semi"), [level], "__v",
                                {"Q1": 0.25, "Median": 0.5, "Q3": 0.75})
    return groups.join(quartiles, level).withColumns({c: F.bround(c, 4) for c in ("Q1", "Median", "Q3")})


def metric_combo(out: DataFrame, level: str, metrics: list[str], fn: str = "Mean", n: int = 15) -> DataFrame:
    """Record count and up to three metrics per group, the ``n`` groups with most records."""
    def value(m):
        v = F.col(m).try_cast("double")
        d = v.try_cast("decimal(28,6)")
        return {"Mean": F.sum(d).cast("double") / F.count(d), "Sum": F.sum(d).cast("double"), "Min": F.min(v),
                "Max": F.max(v), "Count": F.count(v).cast("double"), "StdDev": F.stddev_samp(v)}[fn]

    counted = F.count(F.col(metrics[0]).try_cast("double"))
    return (out.where(_named(level)).groupBy(level)
            .agg(counted.alias("Count"), *[F.bround(value(m), 2).alias(m) for m in metrics])
            .where("Count > 0").orderBy(F.col("Count").desc(), level).limit(n))


def metric_means_top(out: DataFrame, level: str, metrics: list[str], n: int = 15) -> DataFrame:
    """Mean of several metrics per group."""
    return metric_combo(out, level, metrics, "Mean", n)


def metric_extremes(out: DataFrame, level: str, metrics: list[str]) -> DataFrame:
    """Per metric: the groups with the highest and lowest mean and how far apart they are."""
    per = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).try_cast("double").alias("x")) for m in metrics])
    long = out.select(level, F.inline(per)).withColumn("d", F.col("x").try_cast("decimal(28,6)")).where("d is not null")
    sums = long.groupBy("metric", level).agg(F.sum("d").alias("s"), F.count("d").alias("n"))
    whole = Window.partitionBy("metric")
    means = (sums.withColumn("mean", F.sum("s").over(whole).cast("double") / F.sum("n").over(whole))
             .where(_named(level)).withColumn("m", F.col("s").cast("double") / F.col("n")))
    ends = means.groupBy("metric", "mean").agg(
        F.max(F.struct("m", F.col(level).alias("g"))).alias("hi"), F.min(F.struct("m", F.col(level).alias("g"))).alias("lo"))
    spread = F.try_divide(F.col("hi.m") - F.col("lo.m"), F.col("mean"))
    return ends.select(
        "metric", F.bround("mean", 2).alias("overall_mean"), F.col("hi.g").alias("highest"),
        F.bround("hi.m", 2).alias("highest_mean"), F.col("lo.g").alias("lowest"),
        F.bround("lo.m", 2).alias("lowest_mean"),
        F.when(spread > 0.5, "significant").when(spread > 0.2, "moderate").otherwise("consistent").alias("spread"))


# --- time -----------------------------------------------------------------------------------------------------------

def as_time(col) -> Column:
    return F.col(col).try_cast("timestamp")


def period_label(ts: Column, period: str) -> Column:
    """``2024-01-31``, ``2024-01-29/2024-02-04`` (Monday to Sunday) or ``2024-01``."""
    if period == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if period == "month":
        return F.date_format(ts, "yyyy-MM")
    monday = F.date_trunc("week", ts).cast("date")
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def _dated(rows: DataFrame, date: str, period: str) -> DataFrame:
    return rows.where(as_time(date).isNotNull()).withColumn("Period", period_label(as_time(date), period))


def metric_trend(out: DataFrame, level: str, date: str, metric: str, period: str, fn: str = "Mean") -> DataFrame:
    rows = _dated(_metric(out.where(_named(level)), metric), date, period)
    return rows.groupBy("Period").agg(AGGREGATES[fn]().alias("Value"))


def metric_trend_by_group(out: DataFrame, level: str, date: str, metric: str, period: str, fn: str = "Mean",
                          n: int = 5) -> DataFrame:
    """The trend of the ``n`` groups which are highest over all periods."""
    rows = _metric(out.where(_named(level)), metric)
    top = (rows.groupBy(level).agg(AGGREGATES[fn]().alias("__all")).orderBy(F.col("__all").desc(), level).limit(n)
           .select(level))
    return (_dated(rows.join(top, level, "left_semi"), date, period).groupBy("Period", level)
            .agg(AGGREGATES[fn]().alias("Value")))


def category_trend(out: DataFrame, date: str, level: str, period: str, n: int = 7) -> DataFrame:
    """Counts per period of the ``n`` most frequent values."""
    rows = out.where(_named(level) & F.col(level).isNotNull())  # as the join below demands, so that both sides read alike
    counts = _dated(rows, date, period).groupBy("Period", level).agg(F.count("*").alias("Count"))
    # One row per period and value from here on.
    top = (counts.groupBy(level).agg(F.sum("Count").alias("__all")).orderBy(F.col("__all").desc(), level).limit(n)
           .select(level))
    return counts.join(F.broadcast(top), level).select(counts.columns)


def split_date(out: DataFrame, date: str) -> DataFrame:
    """The day of the middle row in time order (the later one of two), found on counts per day."""
    days = (out.select(F.to_date(as_time(date)).alias("day")).where("day is not null")
            .groupBy("day").agg(F.count("*").alias("n")))
    # One row per calendar day.
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return (_with_total(days, count="n").withColumn("upto", upto)
            .where(F.col("upto") > F.floor(F.col("__total") / 2)).agg(F.min("day").alias("split_date")))


def top_movers(out: DataFrame, date: str, level: str, split: str, n: int = 10) -> DataFrame:
    """Counts before and from the split day per value; the ``n`` largest gains and losses."""
    rows = out.where(_named(level) & as_time(date).isNotNull())
    early = as_time(date) < F.lit(split).cast("timestamp")
    counts = rows.groupBy(level).agg(F.count_if(early).alias("Period_1"), F.count_if(~early).alias("Period_2"))
    change = F.col("Period_2") - F.col("Period_1")
    base = F.when(F.col("Period_1") == 0, 1).otherwise(F.col("Period_1"))
    moved = counts.withColumns({"Change": change, "ChangePct": F.bround(change * 100.0 / base, 1)})
    # One row per value from here on; a value may be among the gains and among the losses.
    gain = moved.orderBy(F.col("Change").desc(), level).limit(n).withColumn("Side", F.lit("gain"))
    return gain.union(moved.orderBy("Change", F.col(level).desc()).limit(n).withColumn("Side", F.lit("loss")))


# --- narrative ------------------------------------------------------------------------------------------------------

def narrative_facts(out: DataFrame) -> DataFrame:
    """The figures and verdicts of the executive summary, one row."""
    counts = out.groupBy("Category", "Subcategory").agg(
        F.count("*").alias("n"), F.sum(F.least("match_score", F.lit(100))).alias("points"),
        F.count_if(F.col("match_score") < 30).alias("low"))
    # Totals per category and per subcategory side by side: a few rows, from one pass over the data.
    both = counts.groupingSets([["Category"], ["Subcategory"]], "Category", "Subcategory").agg(
        F.sum("n").alias("n"), F.sum("points").alias("points"), F.sum("low").alias("low"),
        F.grouping("Category").alias("g"))
    cat, named = F.col("g") == 0, F.col("Category") != UNCATEGORIZED
    # With all the figures, so that this side of the join below reads the same shuffled counts as the other.
    by_size = F.struct((-F.col("n")).alias("m"), F.col("Category").alias("c"), "points", "low")
    sub = F.struct((-F.col("n")).alias("m"), F.col("Subcategory").alias("c"))
    total = both.agg(
        F.sum(F.when(cat, F.col("n"))).alias("records"),
        F.coalesce(F.sum(F.when(cat & named, F.col("n"))), F.lit(0)).alias("categorized"),
        F.count_if(cat & named).alias("categories"), F.sum(F.when(cat, F.col("points"))).alias("points"),
        F.sum(F.when(cat, F.col("low"))).alias("low"),
        F.min(F.when(~cat & (F.col("Subcategory") != NOT_AVAILABLE), sub)).alias("sub"))
    three = (both.where(cat & named).select(by_size.alias("t")).orderBy("t").limit(3)
             .agg(F.array_sort(F.collect_list("t")).alias("top")))
    facts = total.crossJoin(F.broadcast(three)).select(
        "*", F.get("top", F.lit(0))["c"].alias("top_category"), (-F.get("top", F.lit(0))["m"]).alias("top_n"),
        F.aggregate("top", F.lit(0).cast("long"), lambda a, t: a - t["m"]).alias("top3"),
        F.col("sub.c").alias("top_sub"))
    coverage = F.col("categorized") * 100.0 / F.col("records")
    avg_conf = F.col("points") / (F.col("records") * 100.0)
    return facts.select(
        "records", "categorized", (F.col("records") - F.col("categorized")).alias("uncategorized"), "categories",
        F.bround(coverage, 1).alias("coverage_pct"),
        F.when(coverage > 90, "excellent").when(coverage > 75, "good").when(coverage > 50, "moderate")
        .otherwise("low").alias("coverage_verdict"),
        "top_category", pct(F.col("top_n"), F.col("records")).alias("top_category_pct"),
        pct(F.col("top3"), F.col("records")).alias("top3_pct"), F.coalesce("top_sub", F.lit("N/A")).alias("top_sub"),
        F.bround(avg_conf, 2).alias("avg_confidence"),
        F.when(avg_conf > 0.7, "high").when(avg_conf > 0.4, "moderate").otherwise("low").alias("confidence_verdict"),
        pct(F.col("low"), F.col("records")).alias("low_confidence_pct"))


def recommendations(out: DataFrame) -> DataFrame:
    """Flags for low coverage, many low-confidence or uncategorized records, one dominating category."""
    counts = out.groupBy("Category").agg(F.count("*").alias("n"),
                                         F.count_if(F.col("match_score") < 30).alias("low"))
    named = F.col("Category") != UNCATEGORIZED
    f = counts.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("done"),
                   F.sum("low").alias("low"), F.coalesce(F.max(F.when(named, F.col("n"))), F.lit(0)).alias("top"))
    total = F.col("total")
    flags = F.array_compact(F.array(
        F.when(F.col("done") * 100.0 / total < 80, "low_coverage"),
        F.when(F.col("low") * 100.0 / total > 20, "low_confidence"),
        F.when(total - F.col("done") > total * 0.15, "many_uncategorized"),
        F.when(F.col("top") / total > 0.3, "dominant_category")))
    return f.select(F.explode(F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit("all_good"))))
                    .alias("recommendation"))


# --- other distributions --------------------------------------------------------------------------------------------

def sentiment_dist(rows: DataFrame, sentiment: str = "sentiment", score: str | None = None) -> DataFrame:
    """Count and share per sentiment (and the mean score)."""
    aggs = [F.count("*").alias("Count")]
    if score:
        aggs.append(F.bround(F.avg(F.col(score).cast("decimal(18,9)")).cast("double"), 6).alias("AvgScore"))
    counts = rows.groupBy(sentiment).agg(*aggs)
    return (_with_total_of_few(counts).withColumn("Pct", pct(F.col("Count"), F.col("__total")))
            .drop("__total"))


def theme_dist(rows: DataFrame, n: int = 10) -> DataFrame:
    return (rows.groupBy("primary_proximity").agg(F.count("*").alias("Count"))
            .orderBy(F.col("Count").desc(), "primary_proximity").limit(n))


def language_share(rows: DataFrame, language: str = "language") -> DataFrame:
    """English against other languages."""
    kind = F.when(F.col(language) == "en", "English").otherwise("Foreign")
    counts = rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("Count"))
    return (_with_total_of_few(counts).withColumn("Pct", pct(F.col("Count"), F.col("__total")))
            .drop("__total"))


def analytics_sql(out: DataFrame, view: str = "results") -> DataFrame:
    """Register the results for SQL and return the standard summary, from one read of them."""
    out.createOrReplaceTempView(view)
    # The row of no records keeps the totals of an empty table.
    return out.sparkSession.sql(f"""
        with pairs as (
            select Category, Subcategory, count(*) as n from {view} group by Category, Subcategory
            union all select cast(null as string), cast(null as string), 0L),
        sums as (
            select Category, grouping(Category) as total, sum(n) as n, count(distinct Category) as l1,
                count(distinct Subcategory) as l2
            from pairs group by grouping sets ((Category), ()))
        select inline(if(total = 0, array(struct('l1' as kind, Category as name, n as n)), array(
            struct('total' as kind, 'total_records' as name, n as n),
            struct('total' as kind, 'unique_l1_categories' as name, l1 as n),
            struct('total' as kind, 'unique_l2_categories' as name, l2 as n))))
        from sums where total = 1 or n > 0""")
