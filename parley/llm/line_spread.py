"""Line deduplication by the spread of a line over sites. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import materialize

SITES = 5
MIN_CHARS = 16
HOT_LINES = 1000
BLANK = " \t\r\x0b\x0c"


def _line(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _key(line: Column) -> Column:
    """What a line is known by: two 64-bit hashes of its trimmed text."""
    trimmed = _line(line)
    return F.struct(F.xxhash64(trimmed).alias("h"), F.xxhash64(F.lit("line"), trimmed).alias("g"))


def _counted(line: Column, min_chars: int) -> Column:
    return F.char_length(_line(line)) >= min_chars


def site_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """``line`` (key), ``site`` and ``id`` of every line that counts."""
    parts = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"),
                        F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("text"))
    return parts.where(_counted(F.col("text"), min_chars)).select(_key(F.col("text")).alias("line"), "site", "id")


def _dealt(lines: DataFrame, table: DataFrame) -> DataFrame:
    """``lines`` with ``hit``, the row that ``table`` (``line``, ``n``, its rows among ``lines``, and more) has for its
    line; lines that it does not hold are left out.

    Lines of a thousandth or more of all rows that ``table`` counts, which are a thousand lines at most, are broadcast;
    their rows are then dealt by a hash of their own, so that a line of a third of all rows goes to every task.
    """
    row = F.struct(*[F.col(c) for c in table.columns if c != "line"]).alias("hit")
    parts = table.withColumn("_hot", F.col("n") >= F.lit(table.agg(F.sum("n")).first()[0] or 0) / HOT_LINES)
    hot = parts.where("_hot").select(F.col("line").alias("_line"), row.alias("_hit"))
    rest = parts.where(~F.col("_hot")).select(F.col("line").alias("_key"), row)
    spare = F.struct(F.xxhash64(*lines.columns).alias("h"), F.lit(0).cast("long").alias("g"))
    met = lines.join(F.broadcast(hot), F.col("line") == F.col("_line"), "left")
    met = met.withColumn("_key", F.when(F.col("_hit").isNull(), F.col("line")).otherwise(spare))
    return (met.join(rest, "_key", "left").withColumn("hit", F.coalesce("_hit", "hit"))
            .where(F.col("hit").isNotNull()).select(*lines.columns, "hit"))


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                sites: int = SITES, min_chars: int = MIN_CHARS, rsd: float = 0.1) -> DataFrame:
    """Lines that stand on ``sites`` or more different sites: ``line``, ``n``, how often it stands in ``docs``, and
    ``first``, the smallest id that holds it.

    A HyperLogLog sketch of the sites of each line is built and merged by one aggregation, so a line that a third of
    all documents hold costs each task one row. Estimates of more than twice the threshold decide; estimates from
    half of it to twice it are near, and those lines' sites are counted exactly (distinct pairs of line and site,
    aggregated before and after the shuffle).
    """
    lines = site_lines(docs, id_col, text_col, site_col, min_chars)
    spread = materialize(
        lines.groupBy("line").agg(F.approx_count_distinct("site", rsd).alias("estimate"), F.min("id").alias("first"),
                                  F.count(F.lit(1)).alias("n")).where(F.col("estimate") >= sites / 2), "line-spread")
    sure = spread.where(F.col("estimate") > 2 * sites).select("line", "n", "first")
    near = spread.where(F.col("estimate") <= 2 * sites).select("line", "n", "first")
    exact = (_dealt(lines.select("line", "site").distinct(), near.select("line", "n")).groupBy("line")
             .agg(F.count("site").alias("n")).where(F.col("n") >= sites).select("line"))
    return materialize(sure.unionByName(near.join(exact, "line", "left_semi")), "boilerplate")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                sites: int = SITES, min_chars: int = MIN_CHARS, rsd: float = 0.1,
                removed_col: str | None = "n_removed") -> DataFrame:
    """The input's rows and columns, texts without cross-site boilerplate, and ``removed_col``, the lines taken out.

    Lines are cut at line feeds and compared without white space at their ends. A line of at least ``min_chars``
    characters on ``sites`` or more sites stays in the document with the smallest id and goes from all others, so no
    line leaves the corpus. The order and the bytes of the remaining lines stay as they are.

    Null texts stay null with nothing removed; empty texts stay empty; a text all of whose lines go becomes empty. A
    null site counts as no site; a row with a null id is never the first (a line that only such rows hold goes from
    all of them). Repeated rows are treated alike, so a repeated first row keeps its lines. Extra columns are kept;
    one named ``removed_col`` is replaced. An empty table gives an empty table.
    """
    columns = [c for c in docs.columns if c != removed_col]
    bad = boilerplate(docs, id_col, text_col, site_col, sites, min_chars, rsd)
    hits = (_dealt(site_lines(docs, id_col, text_col, site_col, min_chars).select("line", F.col("id").alias("_id")), bad)
            .where(~F.col("_id").eqNullSafe(F.col("hit.first")))
            .groupBy("_id").agg(F.collect_set("line").alias("_bad")))
    # The input's columns travel in one struct, so that their names cannot clash with those in use here.
    row = F.col("_row").getField
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")).join(
        hits, row(id_col).eqNullSafe(F.col("_id")), "left")
    parts = F.split(row(text_col).cast("string"), "\n")
    kept = F.filter(parts, lambda x: ~(_counted(x, min_chars) & F.array_contains(F.col("_bad"), _key(x))))
    text = F.when(F.col("_bad").isNull(), row(text_col)).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("_bad").isNull() | row(text_col).isNull(), 0).otherwise(F.size(parts) - F.size(kept))
    out = [(text if c == text_col else row(c)).alias(c) for c in columns]
    return joined.select(*out, *([removed.cast("int").alias(removed_col)] if removed_col else []))


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per document: id, lines before, lines removed, length and MD5 of the remaining text."""
    done = dedup_lines(docs.select("doc_id", "text", "source", F.size(F.split("text", "\n")).alias("n_lines")))
    return done.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"),
                       "n_removed", F.char_length("text").alias("n_chars_left"), F.md5("text").alias("text_md5"))


# The same by exact counts.
LINES_SQL = f"""
WITH parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS part,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    lines AS (SELECT *, trim(part, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM parts),
    bad AS (SELECT line, min(doc_id) AS first FROM lines WHERE length(line) >= {MIN_CHARS} GROUP BY line
        HAVING count(DISTINCT source) >= {SITES}),
    marked AS (SELECT l.doc_id, l.pos, l.part, b.line IS NOT NULL AS gone FROM lines l
        LEFT JOIN bad b ON l.line = b.line AND l.doc_id <> b.first),
    kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars_left, md5(text) AS text_md5 FROM kept"""
