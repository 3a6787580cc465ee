"""Shapes of the result table: projections, renames, cleaning for export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_NAMES = {"l1": "Category", "l2": "Subcategory", "l3": "L3", "l4": "L4"}
EXPORT_COLUMNS = ["Conversation_ID", "Original_Text", "Category", "Subcategory", "L3", "L4", "confidence",
                  "matched_rule"]


def passthrough_result(out: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All input columns and the result columns, id and text and levels under their standard names."""
    renames = {id_col: "Conversation_ID", text_col: "Original_Text", **RESULT_NAMES}
    return out.withColumnsRenamed({k: v for k, v in renames.items() if k != v and k in out.columns})


def project_core(out: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and the four levels."""
    return out.select(F.col(id_col).alias("Conversation_ID"), F.col(text_col).alias("Original_Text"),
                      *[F.col(k).alias(v) for k, v in RESULT_NAMES.items()])


def export_projection(out: DataFrame) -> DataFrame:
    """The fixed export columns, as far as they are present."""
    return out.select(*[c for c in EXPORT_COLUMNS if c in out.columns])


def sanitize_text(df: DataFrame, fmt: str = "csv", max_chars: int | None = None) -> DataFrame:
    """Line breaks to ``' | '``, cells cut to ``max_chars`` after that if it is given; in CSV double quotes become single ones."""
    def clean(name):
        c = F.regexp_replace(F.col(name), r"\r\n|\r|\n", " | ")
        if max_chars is not None:
            c = F.substring(c, 1, max_chars)
        return F.replace(c, F.lit('"'), F.lit("'")) if fmt == "csv" else c

    return df.withColumns({f.name: clean(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Repeated column names get a running suffix; the first keeps its name."""
    return df.toDF(*unique_names(df.columns))


def unique_names(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        out.append(f"{name}_{n}" if n else name)
        seen[name] = n + 1
    return out


def limit_scope(df: DataFrame, id_col: str, n: int = 10_000) -> DataFrame:
    """The first ``n`` rows by id."""
    return df.orderBy(id_col).limit(n)
