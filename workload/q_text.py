"""Text preparation: normalising, tokens, transcripts, speakers, language."""

from pyspark.sql import functions as F

from parley.functions.text import consumer_text, has_speaker_label, normalize, speaker_text, tokens
from parley.operators.language_model import fit_language, with_language_by_model
from parley.operators.polarity import learn_polarity
from parley.operators.scorers import LANGUAGE_PROFILES, min_length_gate, with_language
from workload import sql as S
from workload.data import CONSUMER, LABELS, docs, table, transcripts

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("normalize_text", "SELECT doc_id, lower(coalesce(CAST(text AS VARCHAR), '')) AS norm FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", normalize("text").alias("norm"))


@query("tokenize", f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM
    (SELECT doc_id, {S.tokens('text')} AS t FROM documents)""")
def _(spark, sf):
    return (docs(spark, sf).select("doc_id", tokens(F.col("text")).alias("t"))
            .select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens")))


# Turns with line breaks turned into blanks, as the transcripts have them.
TURNS = "t AS (SELECT conv_id, turn, role, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM conversations)"
_USER = f"""WITH {TURNS} SELECT conv_id, array_to_string(list(s ORDER BY turn), ' ') AS consumer FROM
    (SELECT conv_id, turn, array_to_string({S.words('text')}, ' ') AS s FROM t WHERE role = 'user')
    WHERE s <> '' GROUP BY conv_id"""
_USER_SIMPLE = f"""WITH {TURNS} SELECT conv_id, array_to_string(list(s ORDER BY turn), ' ') AS consumer FROM
    (SELECT conv_id, turn, regexp_replace(text, '^{S.SP}+|{S.SP}+$', '', 'g') AS s FROM t WHERE role = 'user')
    WHERE s <> '' GROUP BY conv_id"""


@query("consumer_text_simple", _USER_SIMPLE)
def _(spark, sf):
    t = transcripts(spark, sf, CONSUMER, "simple")
    return t.select("conv_id", consumer_text(F.col("transcript"), "simple").alias("consumer")).where("consumer <> ''")


@query("consumer_text_multiformat", " UNION ALL ".join(
    f"SELECT '{f}' AS format, * FROM ({_USER})" for f in ("stamped", "bracket", "simple")))
def _(spark, sf):
    out = None
    for style, labels in (("stamped", CONSUMER), ("bracket", LABELS), ("simple", LABELS)):
        one = transcripts(spark, sf, labels, style).select(
            F.lit(style).alias("format"), "conv_id", consumer_text(F.col("transcript"), "multi").alias("consumer"))
        out = one if out is None else out.unionByName(one)
    return out.where("consumer <> ''")


@query("speaker_segments", f"""WITH {TURNS} SELECT conv_id, true AS labelled,
    coalesce(array_to_string(list(regexp_replace(text, '^{S.SP}+|{S.SP}+$', '', 'g') ORDER BY turn)
      FILTER (role = 'user'), ' '), '') AS customer,
    coalesce(array_to_string(list(regexp_replace(text, '^{S.SP}+|{S.SP}+$', '', 'g') ORDER BY turn)
      FILTER (role = 'assistant'), ' '), '') AS agent
    FROM t WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def _(spark, sf):
    t = F.col("transcript")
    return transcripts(spark, sf).select(
        "conv_id", has_speaker_label(t).alias("labelled"), speaker_text(t, "customer").alias("customer"),
        speaker_text(t, "agent").alias("agent"))


@query("build_transcripts", f"""WITH {TURNS} SELECT conv_id, array_to_string(list(
    CASE role WHEN 'user' THEN 'Customer: ' ELSE 'Agent: ' END || text ORDER BY turn), chr(10)) AS transcript
    FROM t WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def _(spark, sf):
    return transcripts(spark, sf)


def language_sql(text: str = "text", table_sql: str = "documents", key: str = "doc_id") -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: list_contains({S.qlist(ws)}, x))) AS c_{lang}"
                       for lang, ws in LANGUAGE_PROFILES.items())
    best = "greatest(" + ", ".join(f"c_{lang}" for lang in LANGUAGE_PROFILES) + ")"
    case = " ".join(f"WHEN c_{lang} = {best} THEN '{lang}'" for lang in LANGUAGE_PROFILES)
    return f"""SELECT {key}, CASE WHEN length(regexp_replace(x, '^{S.SP}+|{S.SP}+$', '', 'g')) < 3 OR {best} = 0
        THEN 'unknown' {case} END AS language
        FROM (SELECT *, {counts} FROM (SELECT {key}, coalesce({text}, '') AS x,
        {S.word_tokens(f"lower(coalesce({text}, ''))")} AS t FROM {table_sql}))"""


@query("detect_language", language_sql())
def _(spark, sf):
    return with_language(docs(spark, sf), "text").select("doc_id", "language")


# The seeds are words of two of the languages, so that learnt weights tell them apart.
_UP, _DOWN = ["the", "and"], ["der", "und"]


@query("learn_polarity", f"""WITH t AS (SELECT list_distinct({S.word_tokens("lower(coalesce(text, ''))")}) AS w FROM documents),
    m AS (SELECT w, list_has_any(w, {S.qlist(_UP)})::INT AS up, list_has_any(w, {S.qlist(_DOWN)})::INT AS down FROM t),
    n AS (SELECT word, count(*) AS texts, sum(up) AS up, sum(down) AS down FROM (SELECT unnest(w) AS word, up, down FROM m)
      GROUP BY 1 HAVING count(*) >= 5),
    b AS (SELECT word, texts, log2((up + 0.5) / ((SELECT sum(up) FROM m) + 1.0)) - log2((down + 0.5) / ((SELECT sum(down) FROM m) + 1.0))
      AS bits FROM n)
    SELECT word, texts, round(bits / (1 + abs(bits)), 6) AS weight FROM b""")
def _(spark, sf):
    return learn_polarity(docs(spark, sf), "text", _UP, _DOWN)


# The same counts, weights and sums over all documents; trigrams by the code points of lower-cased letters.
_GRAMS = r"""g AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i:
      (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 32768)) AS b
    FROM (SELECT doc_id, lang, list_transform(string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')),
      '[^\p{L}\p{M}]+', ' ', 'g')) || ' ', ''), lambda s: unicode(s)) AS c FROM documents))"""


@query("detect_language_model", f"""WITH {_GRAMS},
    n AS (SELECT lang, b, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT lang, sum(n) AS total FROM n GROUP BY 1),
    d AS (SELECT doc_id, b, count(*) AS k FROM g GROUP BY 1, 2),
    s AS (SELECT doc_id, t.lang, sum(k * floor(1000 * ln((coalesce(n, 0) + 1)::DOUBLE / (total + 32768)) + 0.5)::BIGINT) AS s,
        sum(k) AS size
      FROM d CROSS JOIN t LEFT JOIN n ON n.b = d.b AND n.lang = t.lang GROUP BY 1, 2),
    r AS (SELECT doc_id, size, lang, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS place FROM s)
    SELECT d.doc_id, CASE WHEN size >= 3 THEN r.lang ELSE 'unknown' END AS language
    FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND place = 1""")
def _(spark, sf):
    model = fit_language(docs(spark, sf), "text", "lang")
    return with_language_by_model(docs(spark, sf), "text", model).select("doc_id", "language")


@query("min_length_gate", f"""WITH l AS ({language_sql("text", "conversations", "conv_id, turn, role, text")})
    SELECT conv_id, turn, CASE WHEN language <> 'unknown' AND len({S.words('text')}) >= 3 THEN role ELSE '' END AS role
    FROM l""")
def _(spark, sf):
    t = with_language(table(spark, sf, "conversations"), "text")
    return min_length_gate(t, "text", "language", ["role"]).select("conv_id", "turn", "role")
