"""Keyword in context over the classified documents."""

from parley.operators import concordance as C
from parley.operators.reports import uncategorized
from workload import sql as S
from workload.data import results
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


def matches(pattern: str, n: int, where: str = "true") -> str:
    """CTE ``k``: one row per match, contexts cut from the text before and behind it.

    ``pattern`` has one group around the match; the boundary in front of it is looked up by length.
    """
    return f"""d AS (SELECT * FROM res WHERE {where} AND regexp_matches(text, {S.q(pattern)})),
    p AS (SELECT *, string_split_regex(text, {S.q(pattern)}) AS sg, regexp_extract_all(text, {S.q(pattern)}) AS ms FROM d),
    e AS (SELECT *, unnest(range(len(ms))) AS i FROM p),
    o AS (SELECT *, coalesce(list_sum(list_transform(sg[1:i + 1], lambda s: length(s))), 0)
      + coalesce(list_sum(list_transform(ms[1:i], lambda s: length(s))), 0) AS off FROM e),
    w AS (SELECT *, ms[i + 1] AS kw, {S.words('substr(text, 1, off::INT)')} AS lw,
      {S.words('substr(text, off::INT + length(ms[i + 1]) + 1)')} AS rw FROM o),
    k AS (SELECT doc_id AS "Conversation_ID", "Category", "Subcategory", "L3", "L4", text AS "Full_Text", i::INT AS match_no,
      array_to_string(lw[greatest(len(lw) - {n} + 1, 1):], ' ') AS "Left", kw AS "KW",
      array_to_string(rw[1:{n}], ' ') AS "Right", off::INT AS "Match_Position" FROM w)"""


_COLS = '"Conversation_ID", "Category", "Subcategory", match_no, "Left", "KW", "Right"'
_WORD, _PHRASE, _WILD = r"(?i)\bthre\b", r"(?i)of the", r"(?i)thane\w+"


@query("kwic", f"{RES}, {matches(_WORD, 10)} SELECT {_COLS} FROM k")
def _(spark, sf):
    return C.kwic(results(spark, sf), "thre", 10)


@query("kwic_phrase", f"{RES}, {matches(_PHRASE, 5, chr(34) + 'Category' + chr(34) + chr(32) + '= ' + S.q('Technical'))} "
                      f"SELECT {_COLS} FROM k")
def _(spark, sf):
    return C.kwic(results(spark, sf), "of the", 5, "Technical")


@query("kwic_options", f"""{RES}, {matches('Thre', 4, chr(34) + "Category" + chr(34) + " IN ('Service', 'Technical')")}
    SELECT * FROM k WHERE "Subcategory" <> 'none' AND "Category" = 'Service'""")
def _(spark, sf):
    return C.kwic_options(results(spark, sf), "Thre", 4, "Service", case_sensitive=True, regex=True)


@query("kwic_regex", f"{RES}, {matches(_WILD, 6)} SELECT * FROM k")
def _(spark, sf):
    return C.kwic_options(results(spark, sf), r"thane\w+", 6, regex=True)


@query("kwic_subcategory", f"""{RES}, {matches(r'(?i)' + chr(92) + 'berin' + chr(92) + 'b', 6)}
    SELECT * FROM k WHERE "Category" = 'Billing' AND "Subcategory" = 'Charges'""")
def _(spark, sf):
    return C.kwic_options(results(spark, sf), "erin", 6, "Billing", "Charges")


@query("kwic_uncategorized", f"""{RES}, {matches(r'(?i)' + chr(92) + 'bthe' + chr(92) + 'b', 10)}
    SELECT {_COLS} FROM k WHERE "Category" = 'Uncategorized'""")
def _(spark, sf):
    return C.kwic(uncategorized(results(spark, sf)), "the", 10)


@query("kwic_stats", f"""{RES}, {matches(_WORD, 10)} SELECT count(*) AS matches,
    count(DISTINCT "Conversation_ID") AS conversations, count(DISTINCT "Category") AS categories,
    round_even(count(*) * 1.0::DOUBLE / count(DISTINCT "Conversation_ID"), 1) AS avg_per_conversation FROM k""")
def _(spark, sf):
    return C.kwic_stats(C.kwic(results(spark, sf), "thre", 10))


for _c in ("Category", "Subcategory"):
    def _dist(col):
        @query("kwic_distribution" + ("" if col == "Category" else "_sub"),
               f'{RES}, {matches(_WORD, 10)} SELECT "{col}", count(*) AS count FROM k GROUP BY 1')
        def _(spark, sf):
            return C.kwic_distribution(C.kwic(results(spark, sf), "thre", 10), col)
    _dist(_c)


def _colloc(n, min_len):
    return f"""{RES}, {matches(_WORD, 10)}, s AS (SELECT 'left' AS side, unnest({S.content_tokens('"Left"', min_len)}) AS word
      FROM k UNION ALL SELECT 'right', unnest({S.content_tokens('"Right"', min_len)}) FROM k),
    c AS (SELECT side, word, count(*) AS count FROM s GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY side ORDER BY count DESC, word)::INT AS place FROM c
    QUALIFY place <= {n}"""


@query("collocations", _colloc(8, 3))
def _(spark, sf):
    return C.collocations(C.kwic(results(spark, sf), "thre", 10), 8)


@query("collocations_loose", _colloc(10, 0))
def _(spark, sf):
    return C.collocations(C.kwic(results(spark, sf), "thre", 10), 10, min_len=0)
