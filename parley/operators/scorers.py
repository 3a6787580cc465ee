"""Scoring classifiers: weighted groups, keyword-first, topics, themes, sentiment, language, company.

Word lists and packs are configuration, turned into constants; every scorer here is a projection. The conditions of packs,
of any number, are found in one pass over a text (``functions/substrings.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed_values as fv
from parley.fixed_values import NOT_AVAILABLE, UNCATEGORIZED
from parley.functions.once import constant, once
from parley.functions.substrings import occurrences
from parley.functions.terms import clean_term, is_plain_word, term_found
from parley.functions.text import as_text, normalize, strip, word_tokens, words
from parley.operators.containment import contained, text_key
from parley.operators.matching import Index, Rule
from parley.session import materialize

MAX_LIST = 100_000
LEVELS = ["l1", "l2", "l3", "l4"]


def _bounded(df: DataFrame, limit: int, what: str) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} entries; split the list and run it in parts")
    return rows


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _holds(text: Column, needle: str) -> Column:
    return F.contains(text, F.lit(needle))


def ordered_groups(packs: DataFrame | list[dict]) -> list[dict]:
    """Groups with conditions, keywords before rules, each in file order. Packs are configuration, written by people, and
    are read whole, whatever their number of groups."""
    if isinstance(packs, DataFrame):
        packs = [r.asDict() for r in packs.where(F.size("conditions") > 0).collect()]
    groups = [g for g in packs if g["conditions"]]
    return sorted(groups, key=lambda g: (g["kind"] != "keywords", g["group_no"]))


def _group_table(groups: list[dict]) -> Column:
    return constant([{c: g[c] for c in LEVELS} | {"n": len(g["conditions"])} for g in groups],
                    "array<struct<l1:string,l2:string,l3:string,l4:string,n:int>>")


class _Conditions:
    """Literals of all groups, numbered, and for each one the groups that ask for it: ``g``, the place ``k`` in the group
    in the order in which it is counted, ``words`` and ``chars``. Blank conditions ask for nothing."""

    def __init__(self, groups: list[dict], order=None):
        number: dict[str, int] = {}
        self.users: list[list[dict]] = []
        for g, group in enumerate(groups):
            listed = sorted(group["conditions"], key=order) if order else group["conditions"]
            for k, cond in enumerate(listed):
                if not cond:
                    continue
                c = number.setdefault(cond.lower(), len(number))
                if c == len(self.users):
                    self.users.append([])
                self.users[c].append({"g": g, "k": k, "words": len(cond.split()), "chars": len(cond)})
        self.literals = list(number)

    def asked(self, places: Column) -> Column:
        """For all places of literals, who asks for them, with the place: ``g, k, at, words, chars``."""
        users = constant(self.users, "array<array<struct<g:int,k:int,words:int,chars:int>>>")
        return F.flatten(F.transform(places, lambda p: F.transform(F.get(users, p["c"]), lambda u: F.struct(
            u["g"].alias("g"), u["k"].alias("k"), p["at"].alias("at"), u["words"].alias("words"), u["chars"].alias("chars")))))


def category_path(always_four: bool = False, l1="l1", l2="l2", l3="l3", l4="l4") -> Column:
    """``L1 > L2 [> L3]``, or always four levels; only the word Uncategorized without a match."""
    if always_four:
        full = F.concat_ws(" > ", l1, l2, l3, l4)
    else:
        full = F.concat_ws(" > ", F.col(l1), F.col(l2), F.when(F.col(l3) != NOT_AVAILABLE, F.col(l3)))
    return full


def classify_weighted(df: DataFrame, packs, text_col: str) -> DataFrame:
    """Best-scoring group: long, early and dense phrases score higher, several hits add up, keywords beat rules.

    A group takes part if one of its conditions occurs between word boundaries; its score counts every condition that
    occurs anywhere. Adds l1..l4, confidence, match_path.
    """
    groups = ordered_groups(packs)
    low, size = F.col("__low"), F.col("__size")
    index = Index([Rule(str(i), [c for c in g["conditions"] if clean_term(c)]) if any(map(clean_term, g["conditions"]))
                   else Rule(str(i), []) for i, g in enumerate(groups)])
    conditions = _Conditions(groups, order=lambda c: -len(c))
    of_term, kind = constant(index.of_term, "array<array<int>>"), constant(
        [20 if g["kind"] == "keywords" else 10 for g in groups], "array<int>")
    taking_part = F.array_distinct(F.flatten(F.transform("__found", lambda t: F.get(of_term, t))))
    state = "struct<g:int,points:double,chars:int,n:int,best:struct<score:double,order:int>>"
    none = F.lit(None).cast("struct<score:double,order:int>")

    def closed(a):
        score = (a["points"] + a["chars"] / size * 50 + F.when(a["n"] > 1, a["n"] * 5).otherwise(0) + F.get(kind, a["g"])).cast("double")
        return F.when(a["n"] > 0, F.greatest(a["best"], F.struct(score.alias("score"), (-a["g"]).alias("order")))).otherwise(a["best"])

    def step(a, x):
        point = F.lit(10.0) * x["words"] * (F.lit(1.0) - x["at"] / size * 0.3)
        same = a["g"] == x["g"]
        return F.struct(
            x["g"].alias("g"), (F.when(same, a["points"]).otherwise(0.0) + point).alias("points"),
            (F.when(same, a["chars"]).otherwise(0) + x["chars"]).alias("chars"), (F.when(same, a["n"]).otherwise(0) + 1).alias("n"),
            F.when(same, a["best"]).otherwise(closed(a)).alias("best")).cast(state)

    zero = F.struct(F.lit(-1).alias("g"), F.lit(0.0).alias("points"), F.lit(0).alias("chars"), F.lit(0).alias("n"), none.alias("best")).cast(state)
    mine = F.sort_array(F.filter(conditions.asked(F.col("__places")), lambda x: F.array_contains("__groups", x["g"])))
    found = df.withColumn("__low", normalize(text_col)).withColumn("__size", F.length("__low"))
    found = (found.withColumn("__tokens", word_tokens(low)).withColumn("__found", index.found(F.col("__tokens"), low))
             .withColumn("__groups", taking_part).withColumn("__places", occurrences(low, conditions.literals, first=True))
             .withColumn("__best", once(F.aggregate(mine, zero, step, closed)))
             .withColumn("__group", F.get(_group_table(groups), -F.col("__best.order"))))
    return _with_levels(found, F.least(F.col("__best.score") / 100, F.lit(1.0))).withColumn(
        "match_path", F.when(F.col("__group").isNull(), UNCATEGORIZED).otherwise(category_path())).drop(
            "__low", "__size", "__tokens", "__found", "__groups", "__places", "__best", "__group")


def _with_levels(df: DataFrame, confidence: Column) -> DataFrame:
    levels = {c: F.coalesce(F.col(f"__group.{c}"), F.lit(UNCATEGORIZED if c == "l1" else NOT_AVAILABLE))
              for c in LEVELS}
    return df.withColumns(levels | {"confidence": F.when(F.col("__group").isNull(), 0.0).otherwise(confidence)})


def classify_keyword_first(df: DataFrame, packs, text_col: str) -> DataFrame:
    """The first keyword group with a hit; otherwise the rule with the most hits. Substrings count.

    Adds l1..l4, confidence, match_path, matched_rule (null without a match).
    """
    groups = ordered_groups(packs)
    first_rule = sum(g["kind"] == "keywords" for g in groups)
    conditions = _Conditions(groups)
    asked = F.col("__asked")
    state = "struct<g:int,end:int,n:int,best:struct<n:int,order:int>>"
    none = F.lit(None).cast("struct<n:int,order:int>")

    def closed(a):
        return F.when(a["n"] > 0, F.greatest(a["best"], F.struct(a["n"].alias("n"), (-a["g"]).alias("order")))).otherwise(a["best"])

    def step(a, x):
        """Occurrences of a group from left to right, the first condition at each place; one that begins inside the last
        one counted is not counted."""
        same = a["g"] == x["g"]
        counts = ~same | (x["at"] >= a["end"])
        return F.struct(
            x["g"].alias("g"), F.when(counts, x["at"] + x["chars"]).otherwise(a["end"]).alias("end"),
            (F.when(same, a["n"]).otherwise(0) + counts.cast("int")).alias("n"),
            F.when(same, a["best"]).otherwise(closed(a)).alias("best")).cast(state)

    zero = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("end"), F.lit(0).alias("n"), none.alias("best")).cast(state)
    by_place = F.sort_array(F.transform(F.filter(asked, lambda x: x["g"] >= first_rule), lambda x: F.struct(
        x["g"].alias("g"), x["at"].alias("at"), x["k"].alias("k"), x["chars"].alias("chars"))))
    first = F.array_min(F.filter(F.transform(asked, lambda x: x["g"]), lambda g: g < first_rule))
    out = (df.withColumn("__low", normalize(text_col))
           .withColumn("__places", occurrences(F.col("__low"), conditions.literals))
           .withColumn("__asked", conditions.asked(F.col("__places"))).withColumn("__kw", once(first))
           .withColumn("__most", once(F.when(F.col("__kw").isNull(), F.aggregate(by_place, zero, step, closed))))
           .withColumn("__at", F.coalesce(F.col("__kw"), -F.col("__most.order")))
           .withColumn("__group", F.get(_group_table(groups), F.col("__at"))))
    share = F.least(F.col("__most.n") / F.col("__group.n"), F.lit(1.0)) * 0.85
    out = _with_levels(out, F.when(F.col("__kw").isNotNull(), 0.9).otherwise(share))
    return out.withColumns({
        "match_path": F.when(F.col("__at").isNull(), UNCATEGORIZED).otherwise(category_path(always_four=True)),
        "matched_rule": F.when(F.col("__kw").isNotNull(), "keyword_match").otherwise(
            F.concat(F.lit("rule_match_"), F.col("__most.n").cast("string"), F.lit("_conditions"))),
    }).drop("__low", "__places", "__asked", "__kw", "__most", "__at", "__group")


# --- topics ---------------------------------------------------------------------------------------------------------

def _topic_score(style: str, low: Column, word_set: Column, keywords: list[str], phrases: bool = True) -> Column:
    if style == "v1":
        parts = []
        for k in keywords:
            if " " not in k and len(k) <= 3:
                parts.append(term_found(k, low, word_set).cast("double"))
            else:
                parts.append(F.when(_holds(low, k), 1.5 if " " in k else 1.0).otherwise(0.0))
        return _total(parts)
    single = [k for k in keywords if " " not in k]
    parts = [F.size(F.array_intersect(word_set, F.array(*[F.lit(k) for k in single])))] if single else [F.lit(0)]
    if phrases:
        parts += [F.when(_holds(low, k), 2).otherwise(0) for k in keywords if " " in k]
    return _total(parts).cast("double")


def _word_set(style: str, low: Column) -> Column:
    return F.array_distinct(word_tokens(low) if style == "v1" else words(low))


def _first_best(scored: list[tuple[str, Column]]) -> Column:
    """Struct (score, order, name) of the highest score, the first one among equals, null when all are zero."""
    return F.array_max(F.array(*[F.when(s > 0, F.struct(s.alias("score"), F.lit(-i).alias("order"),
                                                        F.lit(name).alias("name")))
                                 for i, (name, s) in enumerate(scored)]))


def classify_topics(df: DataFrame, text_col: str, style: str = "v1", topics: dict | None = None) -> DataFrame:
    """Add ``topic`` ('' without any hit) and ``topic_score``, the score cut to an integer.

    v1: substrings 1 point, phrases 1.5, words of up to three letters only as whole words.
    v2: words of the text 1 point, phrases 2.
    """
    low, known = F.col("__low"), F.col("__set")
    scored = [(name, _topic_score(style, low, known, kws)) for name, kws in (topics or fv.TOPICS).items()]
    return (df.withColumn("__low", normalize(text_col)).withColumn("__set", _word_set(style, low))
            .withColumn("__best", once(_first_best(scored)))
            .withColumns({"topic": F.coalesce("__best.name", F.lit("")),
                          "topic_score": F.coalesce(F.col("__best.score").cast("int"), F.lit(0))})
            .drop("__low", "__set", "__best"))


def classify_subtopics(df: DataFrame, text_col: str, style: str = "v1", subtopics: dict | None = None) -> DataFrame:
    """Add ``subtopic`` and ``subtopic_score``: the same scoring among the children of ``topic``."""
    low, known = F.col("__low"), F.col("__set")
    best = None
    for topic, children in (subtopics or fv.SUBTOPICS).items():
        one = _first_best([(n, _topic_score(style, low, known, kws, phrases=False)) for n, kws in children.items()])
        best = F.when(F.col("topic") == topic, one) if best is None else best.when(F.col("topic") == topic, one)
    return (df.withColumn("__low", normalize(text_col)).withColumn("__set", _word_set(style, low))
            .withColumn("__best", once(best))
            .withColumns({"subtopic": F.coalesce("__best.name", F.lit("")),
                          "subtopic_score": F.coalesce(F.col("__best.score").cast("int"), F.lit(0))})
            .drop("__low", "__set", "__best"))


def apply_overrides(df: DataFrame, text_col: str, topic: str = "topic", subtopic: str = "subtopic",
                    sentiment: str = "sentiment") -> DataFrame:
    """Payment words force subscription/payment, and some of them a negative sentiment; cancelling a subscription
    forces subscription/cancel."""
    low = normalize(text_col)
    pay = _any([_holds(low, w) for w in fv.FORCE_PAYMENT])
    bad = _any([_holds(low, w) for w in fv.FORCE_NEGATIVE])
    leave = _holds(low, "cancel") & _holds(low, "subscription")
    return df.withColumns({
        topic: F.when(pay | leave, "subscription issue").otherwise(F.col(topic)),
        subtopic: F.when(pay, "payment").when(leave, "cancel").otherwise(F.col(subtopic)),
        sentiment: F.when(bad, "negative").otherwise(F.col(sentiment)),
    })


def proximity_themes(df: DataFrame, text_col: str, themes: dict | None = None) -> DataFrame:
    """Add primary_proximity, proximity_group, theme_count, matched_themes.

    The keywords of all themes are found in one pass over a text.
    """
    themes = themes or fv.THEMES
    users: dict[str, list[int]] = {}
    for no, kws in enumerate(themes.values()):
        for k in dict.fromkeys(kws):
            users.setdefault(k, []).append(no)
    always = F.array(*[F.lit(no) for no in users.pop("", [])]).cast("array<int>")  # the empty keyword stands in every text
    asked, names = constant(list(users.values()), "array<array<int>>"), constant(list(themes), "array<string>")
    found = F.flatten(F.transform("__places", lambda p: F.get(asked, p["c"])))
    hits = F.transform(F.array_sort(F.array_distinct(F.concat(always, found))), lambda no: F.get(names, no))
    return (df.withColumn("__low", normalize(text_col))
            .withColumn("__places", occurrences(F.col("__low"), list(users), first=True)).withColumn("__hits", once(hits))
            .withColumns({
                "matched_themes": F.array_sort("__hits"),
                "theme_count": F.size("__hits"),
                "primary_proximity": F.coalesce(F.get("__hits", F.lit(0)), F.lit(UNCATEGORIZED)),
                "proximity_group": F.when(F.size("__hits") > 0, F.array_join(F.array_sort("__hits"), ", "))
                .otherwise(UNCATEGORIZED)})
            .drop("__low", "__places", "__hits"))


# --- sentiment ------------------------------------------------------------------------------------------------------

def read_lexicon(table: DataFrame, word: str = "word", weight: str = "weight") -> dict[str, float]:
    rows = _bounded(table.select(F.lower(word).alias("w"), F.col(weight).cast("double").alias("x"))
                    .where("w <> '' and x is not null").groupBy("w").agg(F.avg("x").alias("x")), MAX_LIST, "lexicon")
    return {r.w: r.x for r in rows}


def _weights(tokens_col: str, lexicon: dict[str, float]) -> Column:
    """Weights of those tokens which the lexicon holds: one hash lookup per token, then one per distinct weight."""
    by_weight: dict[float, list[str]] = {}
    for w, x in lexicon.items():
        # A token is a run of word characters, so no other entry can ever be met.
        if is_plain_word(w):
            by_weight.setdefault(x, []).append(f"'{w}'")
    if not by_weight:
        return F.array().cast("array<double>")
    # Written as SQL text, since a list of thousands of words is one expression there.
    listed = ", ".join(w for ws in by_weight.values() for w in ws)
    chain = " ".join(f"when t in ({', '.join(ws)}) then double('{x!r}')" for x, ws in by_weight.items())
    return F.expr(f"transform(filter({tokens_col}, t -> t in ({listed})), t -> case {chain} end)")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def with_tokens(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add the words of the lower-cased text, for operators that take them as ``tokens_col``."""
    return df.withColumn(out, once(word_tokens(normalize(text_col))))


def _tokenized(df: DataFrame, text_col: str, tokens_col: str | None) -> DataFrame:
    return df.withColumn("__tokens", F.col(tokens_col)) if tokens_col else with_tokens(df, text_col, "__tokens")


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, _sum(values) / F.size(values)).otherwise(0.0)


def with_polarity(df: DataFrame, text_col: str, polarity: dict[str, float], out: str = "polarity",
                  tokens_col: str | None = None) -> DataFrame:
    """Mean weight of the words in the polarity lexicon, 0 if there are none."""
    return (_tokenized(df, text_col, tokens_col).withColumn("__w", once(_weights("__tokens", polarity)))
            .withColumn(out, _mean(F.col("__w"))).drop("__w", "__tokens"))


def sentiment_hybrid(df: DataFrame, text_col: str, polarity: dict[str, float], valence: dict[str, float],
                     out: str = "sentiment") -> DataFrame:
    """Five labels from mean polarity and summed valence; '' below three characters, neutral below three words."""
    lim, wt = fv.SENTIMENT_LIMITS, fv.SENTIMENT_WEIGHTS
    scored = (_tokenized(df, text_col, None)
              .withColumn("__p", once(_weights("__tokens", polarity)))
              .withColumn("__v", once(_weights("__tokens", valence)))
              .withColumn("__s", once(_mean(F.col("__p")) * wt["polarity"] + _sum(F.col("__v")) / 5.0 * wt["valence"])))
    s, text = F.col("__s"), as_text(text_col)
    return scored.withColumn(
        out, F.when(F.length(strip(text)) < 3, "").when(F.size(words(text)) < 3, "neutral")
        .when(s <= lim["very_negative"], "very negative").when(s <= lim["negative"], "negative")
        .when(s >= lim["very_positive"], "very positive").when(s >= lim["positive"], "positive")
        .otherwise("neutral")).drop("__p", "__v", "__s", "__tokens")


def sentiment_band(polarity: Column) -> Column:
    return (F.when(polarity >= 0.5, "Very Positive").when(polarity >= 0.1, "Positive")
            .when(polarity <= -0.5, "Very Negative").when(polarity <= -0.1, "Negative").otherwise("Neutral"))


def sentiment_bands(df: DataFrame, text_col: str, polarity: dict[str, float], tokens_col: str | None = None) -> DataFrame:
    """Add sentiment (five labels) and sentiment_score."""
    return with_polarity(df, text_col, polarity, "sentiment_score", tokens_col).withColumn(
        "sentiment", sentiment_band(F.col("sentiment_score")))


# --- language, gate, company ----------------------------------------------------------------------------------------

# Frequent function words per language; the language with most of them in a text wins.
LANGUAGE_PROFILES = {
    "en": ["the", "of", "and", "to", "is", "that", "it", "was", "for", "with", "this", "be", "are", "by", "from"],
    "fr": ["le", "la", "les", "et", "des", "un", "une", "du", "est", "pour", "qui", "dans", "par", "sur", "au"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "ist", "mit", "sich", "dem", "nicht", "ein", "eine", "im"],
    "es": ["el", "los", "las", "y", "del", "se", "que", "por", "con", "una", "para", "es", "lo", "su", "al"],
}


def with_language(df: DataFrame, text_col: str, profiles: dict[str, list[str]] | None = None,
                  out: str = "language", tokens_col: str | None = None) -> DataFrame:
    """Add the language whose function words are most frequent; ``unknown`` for short texts or without any."""
    profiles = profiles or LANGUAGE_PROFILES
    listed = sorted({w for ws in profiles.values() for w in ws})

    def share(ws):
        return F.size(F.filter("__listed", lambda t: t.isin(ws))).cast("double")

    counts = [(lang, share(ws)) for lang, ws in profiles.items()]
    text = as_text(text_col)
    return (_tokenized(df, text_col, tokens_col).withColumn("__listed", once(F.filter("__tokens", lambda t: t.isin(listed))))
            .withColumn("__lang", once(_first_best(counts)))
            .withColumn(out, F.when(F.length(strip(text)) < 3, "unknown").otherwise(
                F.coalesce("__lang.name", F.lit("unknown")))).drop("__tokens", "__listed", "__lang"))


def long_enough(text_col: str, language_col: str, min_words: int = 3) -> Column:
    """Whether a text is worth classifying: not blank, of a known language, at least three words."""
    return (F.col(language_col) != "unknown") & (F.size(words(F.col(text_col))) >= min_words)


def min_length_gate(df: DataFrame, text_col: str, language_col: str, result_cols: list[str]) -> DataFrame:
    """Blank the result columns of texts which are not worth classifying."""
    ok = long_enough(text_col, language_col)
    return df.withColumns({c: F.when(ok, F.col(c)).otherwise("") for c in result_cols})


HOT_SHARE = 1000  # names of at least one in so many rows, at most that many names, are joined by a broadcast


def _spread(df: DataFrame) -> Column:
    """A hash of what a row holds, to deal out rows that have nothing to meet."""
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(F.lit(0), *plain)


def detect_industry(df: DataFrame, company_col: str, companies: DataFrame, out: str = "industry",
                    names: DataFrame | None = None) -> DataFrame:
    """Add the industry of the first listed company which equals, contains or is contained in the name.

    ``companies`` (industry_no, industry, company_no, company) may be of any size. Each different name is decided
    once, by an index on rare grams (``contained``): no name is held against all companies, and long names cost their
    grams. Names of a thousandth of all rows or more find their industry by a broadcast, so no name is one task.
    Null without a match; blank names and blank companies match nothing. The names are read once before the rows; where
    the rows are costly to work out, ``names`` gives the same column of the table they are made from.
    """
    place = F.min(F.struct("industry_no", "company_no", "industry")).alias("place")
    listed = (companies.withColumn("text", F.lower("company")).where(F.trim("text") != "").groupBy("text").agg(place)
              .withColumn("key", text_key(F.col("text"))))
    name = F.trim(F.lower(F.col(company_col)))
    counted = (df if names is None else names).select(name.alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    # Written once: both are read several times below.
    listed = materialize(listed, "companies")
    counted = materialize(counted.withColumn("key", text_key(F.col("text"))), "names")
    called, firms = (t.select("key", "text") for t in (counted, listed))

    inside = contained(firms, called).select(F.col("long").alias("__name"), F.col("short").alias("key"))
    around = contained(called, firms).select(F.col("short").alias("__name"), F.col("long").alias("key"))
    best = (inside.unionByName(around).join(listed.select("key", "place"), "key").groupBy("__name")
            .agg(F.min("place")["industry"].alias("__industry")))

    total = counted.agg(F.sum("n").alias("total")).scalar()
    hot = F.broadcast(counted.where(F.col("n") * HOT_SHARE >= total).select(F.col("key").alias("__hot")))
    keyed = df.withColumn("__key", F.when(name != "", text_key(name))).join(hot, F.col("__key") == F.col("__hot"), "left")
    # Rows without a name, and those of hot names, are dealt by all they hold; ``__cold`` tells that they meet nothing there.
    cold = F.col("__key").isNotNull() & F.col("__hot").isNull()
    dealt = keyed.withColumn("__cold", cold).withColumn(
        "__at", F.when(cold, F.col("__key")).otherwise(F.encode(_spread(df).cast("string"), "utf-8")))
    few = F.broadcast(best.join(hot, F.col("__name") == F.col("__hot"), "left_semi").select(
        F.col("__name").alias("__few"), F.col("__industry").alias("__hot_industry")))
    rest = best.select(F.lit(True).alias("__match"), F.col("__name"), F.col("__industry"))
    met = (dealt.join(few, F.col("__hot") == F.col("__few"), "left")
           .join(rest, (F.col("__at") == F.col("__name")) & (F.col("__cold") == F.col("__match")), "left"))
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c != out],
                      F.coalesce("__hot_industry", "__industry").alias(out))
