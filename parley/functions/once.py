"""Keep a costly expression in one place of the plan, and nested constants small in code."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(col: Column) -> Column:
    """The same value, evaluated where it stands; the only generator of its ``select`` or ``withColumn``.

    Catalyst moves filters below projections by copying the projected expressions into them, and would so evaluate a
    classification once per condition on its result. What a generator makes is not copied: a filter on it stays
    above, and one on the table's own columns still goes below, down to the scan.
    """
    return F.explode(F.array(col))


def constant(value, schema: str) -> Column:
    """A nested value as one constant of the plan (folded by the optimizer, so its size adds no code)."""
    return F.from_json(F.lit(json.dumps(value)), schema)
