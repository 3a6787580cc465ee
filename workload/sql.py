"""Building blocks of the check SQL, written apart from the Spark expressions."""

from __future__ import annotations

from parley import fixed_values as fv

W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
NW = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
SP = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NSP = r"[^\t-\r\x1c-\x20\x85\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qlist(items) -> str:
    items = list(items)
    return "[" + ", ".join(q(i) for i in items) + "]" if items else "[]::VARCHAR[]"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NSP}+')"


def word_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{W}+')"


def tokens(x: str) -> str:
    return f"list_transform({words(f'lower({x})')}, lambda w: trim(w, '.,!?;:'))"


def content_tokens(x: str, min_len: int = 3) -> str:
    raw = f"list_filter({words(f'lower({x})')}, lambda w: length(w) >= {min_len})"
    return (f"list_filter(list_transform({raw}, lambda w: trim(w, '.,!?;:')), "
            f"lambda w: NOT list_contains({qlist(fv.STOP_WORDS)}, w))")


def esc(literal: str) -> str:
    out = ""
    for ch in literal:
        out += ("\\" + ch) if (not ch.isalnum() and ch not in " _" and ord(ch) < 128) else ch
    return out


def body(term: str) -> str:
    return f"{W}*".join(esc(p) for p in term.strip().lower().split("*"))


def bounded(term: str) -> str:
    return f"(^|{NW}){body(term)}($|{NW})"


def has(term: str, low: str = "low", toks: str = "toks") -> str:
    t = term.strip().lower()
    if all(c.isalnum() or c == "_" for c in t):
        return f"list_contains({toks}, {q(t)})"
    return f"regexp_matches({low}, {q(bounded(t))})"


def near(a: str, b: str, n: int, low: str = "low") -> str:
    gap = f"{NW}+({W}+{NW}+){{0,{n}}}"
    x, y = body(a), body(b)
    return (f"regexp_matches({low}, {q(f'(^|{NW}){x}{gap}{y}($|{NW})')}) OR "
            f"regexp_matches({low}, {q(f'(^|{NW}){y}{gap}{x}($|{NW})')})")


def positions(term: str, ws: str = "ws") -> str:
    """Whitespace-word numbers of a one-word term; a match behind leading punctuation counts as one word later."""
    b = body(term)
    return (f"list_concat("
            f"list_transform(list_filter(range(len({ws})), lambda i: regexp_matches({ws}[i + 1], "
            f"{q(f'^{b}($|{NW})')})), lambda i: i), "
            f"list_transform(list_filter(range(len({ws})), lambda i: regexp_matches({ws}[i + 1], "
            f"{q(f'{NW}{b}($|{NW})')})), lambda i: i + 1))")


def rule_predicate(rule: dict, text: str = "text") -> str:
    """A rule as a SQL condition over low, toks, ws (lower-case words) and the text."""
    terms, ops = rule["terms"], rule.get("operators", [])
    state = has(terms[0])
    for i in range(1, len(terms)):
        op = ops[i - 1] if i - 1 < len(ops) else "AND"
        t = has(terms[i])
        if op == "OR":
            state = f"({state} OR {t})"
        elif op in ("NOT", "NOT LIKE"):
            state = f"({state} AND NOT {t})"
        elif op == "NEAR":
            n = rule.get("proximity") or 5
            if n <= 5:
                state = f"({state} AND ({near(terms[i - 1], terms[i], n)}))"
            else:
                a, b = positions(terms[i - 1]), positions(terms[i])
                pair = (f"len(list_filter({a}, lambda p: len(list_filter({b}, lambda z: abs(p - z) <= {n})) > 0)) > 0")
                state = f"({state} AND {t} AND {pair})"
        else:
            state = f"({state} AND {t})"
    for e in rule.get("exclude_if", []):
        state = f"({state} AND NOT {has(e)})"
    pos, n = rule.get("position"), rule.get("within_words", 50)
    if pos == "START":
        state = f"({state} AND regexp_matches(array_to_string(ws[1:{n}], ' '), {q(bounded(terms[0]))}))"
    elif pos == "END":
        state = (f"({state} AND regexp_matches(array_to_string(ws[greatest(len(ws) - {n} + 1, 1):], ' '), "
                 f"{q(bounded(terms[0]))}))")
    return state


def rule_values(rules: list[dict]) -> str:
    """The rules as a table with their scores worked out in SQL."""
    rows = []
    for i, r in enumerate(rules):
        rows.append(f"({i}, {q(r['rule_id'])}, {qlist(r['terms'])}, {qlist(r.get('operators', []))}, "
                    f"{q(r['position']) if r.get('position') else 'NULL'}, {q(r['l1'])}, "
                    f"{q(r.get('l2', 'NA'))}, {q(r.get('l3', 'NA'))}, {q(r.get('l4', 'NA'))}, "
                    f"{q(r.get('sentiment', ''))})")
    table = "(VALUES " + ",\n".join(rows) + ") v(ord, rule_id, terms, ops, pos, l1, l2, l3, l4, sentiment)"
    return f"""rules AS (SELECT *, CAST(10 + 10 * len(regexp_extract_all(array_to_string(terms, ' '), '{NSP}+'))
        + CASE WHEN len(ops) > 0 THEN 10 ELSE 0 END + CASE WHEN list_contains(ops, 'NEAR') THEN 15 ELSE 0 END
        + CASE WHEN list_contains(ops, 'NOT LIKE') THEN 5 ELSE 0 END
        + CASE WHEN pos IN ('START', 'END') THEN 5 ELSE 0 END AS INTEGER) AS score FROM {table}),
    ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS rnk,
        CASE len(terms) WHEN 1 THEN terms[1]
          WHEN 2 THEN concat_ws(' ', terms[1], ops[1], terms[2])
          ELSE concat_ws(' ', terms[1], ops[1], terms[2], ops[2], terms[3]) END AS detail FROM rules)"""


def prepared(source: str = "documents", key: str = "doc_id", text: str = "text", extra: str = "") -> str:
    return f"""prep AS MATERIALIZED (SELECT *, {word_tokens('low')} AS toks, {words('low')} AS ws FROM
        (SELECT {key}, {text} AS text, lower(coalesce({text}, '')) AS low{extra} FROM {source}))"""


def classified(rules: list[dict], source: str = "documents", key: str = "doc_id", text: str = "text",
               extra: str = "") -> str:
    """CTEs ending in ``res``: one row per text with the result columns."""
    marks = ", ".join(f"CASE WHEN {rule_predicate(r)} THEN {i} END" for i, r in enumerate(rules))
    return f"""{rule_values(rules)}, {prepared(source, key, text, extra)},
    hits AS MATERIALIZED (SELECT *, list_filter([{marks}], lambda x: x IS NOT NULL) AS ords FROM prep),
    pairs AS (SELECT {key}, unnest(ords) AS ord FROM hits),
    best AS (SELECT {key}, arg_min(r.ord, r.rnk) AS ord FROM pairs p JOIN ranked r USING (ord) GROUP BY {key}),
    res AS (SELECT h.*, coalesce(r.l1, 'Uncategorized') AS "Category", coalesce(r.l2, 'NA') AS "Subcategory",
        coalesce(r.l3, 'NA') AS "L3", coalesce(r.l4, 'NA') AS "L4",
        least(coalesce(r.score, 0) / 100.0, 1.0)::DOUBLE AS confidence, coalesce(r.rule_id, '') AS matched_rule,
        coalesce(r.score, 0) AS match_score, coalesce(r.detail, '') AS match_detail,
        coalesce(r.sentiment, '') AS rule_sentiment
        FROM hits h LEFT JOIN best b USING ({key}) LEFT JOIN ranked r USING (ord))"""


# --- personal data --------------------------------------------------------------------------------------------------

LUHN = ("len(m) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(m) + 1), lambda i: "
        "CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(substr(m, len(m) - i + 1, 1) AS INT) * 2 > 9 "
        "THEN CAST(substr(m, len(m) - i + 1, 1) AS INT) * 2 - 9 "
        "ELSE CAST(substr(m, len(m) - i + 1, 1) AS INT) * 2 END "
        "ELSE CAST(substr(m, len(m) - i + 1, 1) AS INT) END)) % 10 = 0")
SSN_OK = ("split_part(m, '-', 1) NOT IN ('000', '666') AND NOT starts_with(m, '9') "
          "AND split_part(m, '-', 2) <> '00' AND split_part(m, '-', 3) <> '0000'")
IP_OK = "len(list_filter(string_split(m, '.'), lambda o: CAST(o AS BIGINT) > 255)) = 0"
DOB_OK = "CAST(right(m, 4) AS INT) BETWEEN 1900 AND year(current_date)"


def find(pattern: str, valid: str | None = None, group: int = 0, x: str = "r") -> str:
    found = f"regexp_extract_all({x}, {q(pattern)}, {group})"
    return f"list_filter({found}, lambda m: {valid})" if valid else found


CONDITION = "(?i)" + "|".join(sorted(fv.CONDITIONS, key=lambda c: -len(c)))
SQL_DETECTORS = {
    "EMAIL": [find(fv.EMAIL)], "PHONE": [find(p) for p in fv.PHONES], "CARD": [find(fv.CARD, LUHN)],
    "CARDS": [find(p, LUHN) for p in fv.CARD_BRANDS], "SSN": [find(fv.SSN, SSN_OK)], "DOB": [find(fv.DOB)],
    "DOB_CHECKED": [find(fv.DOB, DOB_OK)], "MRN": [find(fv.MRN, group=1)], "IP": [find(fv.IP, IP_OK)],
    "ADDRESS": [find(fv.ADDRESS)],
    "CONDITION": [f"list_transform(list_reverse_sort(list_transform({find(CONDITION)}, "
                  f"lambda c: {{'l': length(c), 'v': c}})), lambda s: s.v)"],
}


def token(kind: str, mode: str, m: str = "m") -> str:
    return {"mask": q(f"[{kind}:{'*' * 10}]"), "token": q(f"[{kind}]"), "remove": "''"}.get(
        mode, f"'[{kind}:' || substr(sha256({m}), 1, 8) || ']'")


def redaction(kinds: list[str], mode: str = "hash", source: str = "documents", key: str = "doc_id",
              text: str = "text") -> str:
    """CTEs ending in ``red``: key, text, r (redacted) and one count column n_<i> per detector."""
    steps = [(k, d) for k in kinds for d in SQL_DETECTORS[k]]
    ctes = [f"s0 AS (SELECT {key}, {text} AS text, coalesce({text}, '') AS r FROM {source})"]
    for i, (kind, matches) in enumerate(steps, 1):
        name = {"CARDS": "CARD", "DOB_CHECKED": "DOB"}.get(kind, kind)
        ctes.append(f"f{i} AS (SELECT *, {matches} AS m{i} FROM s{i - 1})")
        ctes.append(f"s{i} AS (SELECT * EXCLUDE (r, m{i}), list_reduce(list_prepend(r, m{i}), "
                    f"lambda acc, m: replace(acc, m, {token(name, mode)})) AS r, len(m{i}) AS n_{i} FROM f{i})")
    ctes.append(f"red AS MATERIALIZED (SELECT * FROM s{len(steps)})")
    return ",\n".join(ctes)


def count_of(kinds: list[str], wanted: str) -> str:
    """Sum of the count columns of one kind, for the detectors of ``redaction(kinds)``."""
    cols, i = [], 0
    for k in kinds:
        for _ in SQL_DETECTORS[k]:
            i += 1
            if wanted in ("*", {"CARDS": "CARD", "DOB_CHECKED": "DOB"}.get(k, k)):
                cols.append(f"n_{i}")
    return "(" + " + ".join(cols) + ")" if cols else "0"


VALIDATED = ["EMAIL", "PHONE", "CARD", "SSN", "DOB", "MRN", "IP", "ADDRESS"]
FULL = ["EMAIL", "CARDS", "SSN", "PHONE", "DOB_CHECKED", "MRN", "IP", "ADDRESS", "CONDITION"]
FAST = ["EMAIL", "PHONE"]


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"round_even({part} * 100.0::DOUBLE / {whole}, {digits})"
