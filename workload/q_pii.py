"""Detection and redaction of personal data, compliance reports."""

from pyspark.sql import functions as F

from parley import fixed_values as fv
from parley.functions.pii import (
    SINGLE,
    pii_columns,
    with_hardened_redaction,
    with_names_redacted,
    with_redaction,
)
from parley.operators.compliance import audit_log, compliance_summary, pii_type_distribution
from workload import sql as S
from workload.data import docs, table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


# The documents hold no social security numbers, birth dates, record numbers or diseases; these are appended, made from
# the id, valid ones and invalid ones.
_N4 = "lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')"
_N3 = "lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0')"
_MADE_SQL = f"""made AS (SELECT doc_id, text || ' SSN ' || {_N3} || '-45-' || {_N4} || ' born 0' || CAST(doc_id % 10 AS VARCHAR)
    || '/1' || CAST(doc_id % 7 AS VARCHAR) || '/' || CAST(1890 + doc_id % 200 AS VARCHAR) || ', MRN: AB' || {_N4}
    || ' medical record ' || {_N3} || '777 has ' || CASE lang WHEN 'en' THEN 'Diabetes' WHEN 'fr' THEN 'COVID-19 and covid'
    WHEN 'de' THEN 'heart attack' ELSE 'a cold' END AS text FROM documents)"""


def _made(spark, sf):
    d = docs(spark, sf)
    i = F.col("doc_id")
    n4, n3 = F.lpad((i % 10000).cast("string"), 4, "0"), F.lpad((i % 1000).cast("string"), 3, "0")
    ill = (F.when(F.col("lang") == "en", "Diabetes").when(F.col("lang") == "fr", "COVID-19 and covid")
           .when(F.col("lang") == "de", "heart attack").otherwise("a cold"))
    return d.select("doc_id", F.concat(
        "text", F.lit(" SSN "), n3, F.lit("-45-"), n4, F.lit(" born 0"), (i % 10).cast("string"), F.lit("/1"),
        (i % 7).cast("string"), F.lit("/"), (F.lit(1890) + i % 200).cast("string"), F.lit(", MRN: AB"), n4,
        F.lit(" medical record "), n3, F.lit("777 has "), ill).alias("text"))


def _single(name, kind, made=False, sql_kind=None, mode="hash"):
    source = "made" if made else "documents"
    kinds = [sql_kind or kind]
    head = f"{_MADE_SQL}, " if made else ""
    sql = (f"WITH {head}{S.redaction(kinds, mode, source)} SELECT doc_id, {S.count_of(kinds, '*')}::INT AS items, "
           f"r AS redacted FROM red")

    @query(name, sql)
    def _(spark, sf):
        d = _made(spark, sf) if made else docs(spark, sf).select("doc_id", "text")
        out = with_redaction(d, "text", SINGLE[kind], mode, "redacted")
        return out.select("doc_id", F.aggregate("pii_found", F.lit(0), lambda a, n: a + n).alias("items"), "redacted")


_single("pii_email", "EMAIL")
_single("pii_phone", "PHONE")
_single("pii_card_luhn", "CARD")
_single("pii_ssn", "SSN", made=True)
_single("pii_dob", "DOB", made=True)
_single("pii_dob_checked", "DOB_CHECKED", made=True)
_single("pii_mrn", "MRN", made=True)
_single("pii_ip", "IP")
_single("pii_address", "ADDRESS")
_single("pii_condition", "CONDITION", made=True)


# Every second word of the test items is a name, and the list counts as one too long for a constant of the plan.
_MANY_SQL = f"names AS (SELECT DISTINCT w AS name FROM (SELECT unnest({S.word_tokens('text')}) AS w FROM benchmark) WHERE length(w) % 2 = 0)"


@query("pii_names_joined", f"""WITH {_MANY_SQL},
    w AS (SELECT text, unnest(list_distinct({S.word_tokens('text')})) AS w FROM (SELECT DISTINCT text FROM documents)),
    f AS (SELECT text, list_sort(list(w)) AS found FROM w JOIN names ON w = name GROUP BY text)
    SELECT doc_id, coalesce(array_to_string(found, ' '), '') AS names_found, CASE WHEN found IS NULL THEN d.text ELSE
      list_reduce(list_prepend(d.text, list_transform(list_reverse_sort(list_transform(found,
      lambda n: {{'l': length(n), 'v': n}})), lambda s: s.v)),
      lambda acc, m: replace(acc, m, {S.token('NAME', 'hash')})) END AS redacted
    FROM documents d LEFT JOIN f ON d.text = f.text""")
def _(spark, sf):
    from parley.functions.text import word_tokens
    names = (table(spark, sf, "benchmark").select(F.explode(word_tokens(F.col("text"))).alias("name"))
             .where(F.length("name") % 2 == 0))
    out = with_names_redacted(docs(spark, sf).select("doc_id", "text"), "doc_id", "text", names, "name", most_listed=0)
    return out.select("doc_id", F.array_join("names_found", " ").alias("names_found"),
                      F.col("redacted_text").alias("redacted"))


_NAMES_SQL = f"names AS (SELECT DISTINCT {S.word_tokens('text')}[1] AS name FROM benchmark)"


@query("pii_name_gazetteer", f"""WITH {_NAMES_SQL},
    l AS (SELECT list(name) AS listed FROM names),
    f AS (SELECT doc_id, text, list_sort(list_filter(list_distinct({S.word_tokens('text')}),
      lambda w: list_contains(listed, w))) AS found FROM documents, l)
    SELECT doc_id, array_to_string(found, ' ') AS names_found, list_reduce(list_prepend(text,
      list_transform(list_reverse_sort(list_transform(found, lambda n: {{'l': length(n), 'v': n}})), lambda s: s.v)),
      lambda acc, m: replace(acc, m, {S.token('NAME', 'hash')})) AS redacted FROM f""")
def _(spark, sf):
    from parley.functions.text import word_tokens
    names = table(spark, sf, "benchmark").select(F.get(word_tokens(F.col("text")), F.lit(0)).alias("name"))
    out = with_names_redacted(docs(spark, sf).select("doc_id", "text"), "doc_id", "text", names, "name")
    return out.select("doc_id", F.array_join("names_found", " ").alias("names_found"),
                      F.col("redacted_text").alias("redacted"))


for _mode in ("hash", "mask", "token", "remove"):
    def _mode_query(mode):
        @query(f"redact_{mode}", f"""WITH {S.redaction(S.VALIDATED, mode)}
            SELECT doc_id, {S.count_of(S.VALIDATED, '*')}::INT AS items, r AS redacted FROM red""")
        def _(spark, sf):
            out = pii_columns(docs(spark, sf).select("doc_id", "text"), "text", "validated", mode)
            return out.select("doc_id", F.col("total_items").alias("items"), F.col("redacted_text").alias("redacted"))
    _mode_query(_mode)


def _hardened_sql(mode, source="documents"):
    expr = "coalesce(text, '')"
    for kind, pattern in fv.HARDENED:
        tag = f"[{kind}]" if mode == "token" else f"[{kind}:REDACTED]"
        expr = f"regexp_replace({expr}, {S.q(pattern)}, '{tag}', 'g')"
    return f"SELECT doc_id, {expr} AS redacted FROM {source}"


@query("redact_hardened", f"WITH {_MADE_SQL} {_hardened_sql('hash', 'made')}")
def _(spark, sf):
    return with_hardened_redaction(_made(spark, sf), "text", "hash", "redacted").select("doc_id", "redacted")


@query("redact_hardened_token", _hardened_sql("token"))
def _(spark, sf):
    return with_hardened_redaction(docs(spark, sf), "text", "token", "redacted").select("doc_id", "redacted")


@query("redact_fast", f"""WITH {S.redaction(S.FAST)}
    SELECT doc_id, {S.count_of(S.FAST, '*')}::INT AS items, r AS redacted FROM red""")
def _(spark, sf):
    out = pii_columns(docs(spark, sf).select("doc_id", "text"), "text", "fast")
    return out.select("doc_id", F.col("total_items").alias("items"), F.col("redacted_text").alias("redacted"))


_KINDS = ["EMAIL", "CARD", "SSN", "PHONE", "DOB", "MRN", "IP", "ADDRESS", "CONDITION"]
_FULL = f"{_MADE_SQL}, {S.redaction(S.FULL, 'hash', 'made')}"
_COUNTS = ", ".join(f"{S.count_of(S.FULL, k)}::INT AS {fv.PII_COUNTERS[k]}" for k in _KINDS)


@query("pii_counts", f"""WITH {_FULL} SELECT doc_id, {_COUNTS}, {S.count_of(S.FULL, '*')}::INT AS total_items,
    {S.count_of(S.FULL, '*')} > 0 AS pii_detected FROM red""")
def _(spark, sf):
    out = pii_columns(_made(spark, sf), "text", "full")
    return out.select("doc_id", *[F.coalesce(F.try_element_at("pii_counts", F.lit(fv.PII_COUNTERS[k])), F.lit(0))
                                  .alias(fv.PII_COUNTERS[k]) for k in _KINDS], "total_items", "pii_detected")


@query("pii_type_distribution", f"WITH {_FULL} " + " UNION ALL ".join(
    f"SELECT '{fv.PII_COUNTERS[k]}' AS pii_type, sum({S.count_of(S.FULL, k)})::BIGINT AS items FROM red "
    f"HAVING sum({S.count_of(S.FULL, k)}) > 0" for k in _KINDS))
def _(spark, sf):
    return pii_type_distribution(pii_columns(_made(spark, sf), "text", "full"))


@query("compliance_summary", f"""WITH {S.redaction(S.FULL)}, x AS (SELECT {S.count_of(S.FULL, '*')} AS n FROM red)
    SELECT count(*) AS records, count(*) FILTER (n > 0) AS with_pii, count(*) FILTER (n = 0) AS clean,
    count(*) FILTER (n > 0) * 100.0::DOUBLE / count(*) AS detection_rate, sum(n)::BIGINT AS items,
    count(*) FILTER (n > 0) AS audit_entries, 'HIPAA, GDPR, PCI-DSS, CCPA' AS standards FROM x""")
def _(spark, sf):
    return compliance_summary(pii_columns(docs(spark, sf), "text", "full"))


@query("audit_log", f"""WITH {S.redaction(S.FULL)} SELECT doc_id AS conversation_id, {S.count_of(S.FULL, 'EMAIL')}::INT AS emails,
    {S.count_of(S.FULL, '*')}::INT AS total_items FROM red WHERE {S.count_of(S.FULL, '*')} > 0""")
def _(spark, sf):
    log = audit_log(pii_columns(docs(spark, sf), "text", "full"), "doc_id", with_time=False)
    return log.select("conversation_id", F.coalesce(F.try_element_at("pii_counts", F.lit("emails")), F.lit(0))
                      .alias("emails"), "total_items")
