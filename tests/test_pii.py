"""Detectors, validators and redaction modes on golden texts."""

import hashlib
import re

import pytest

from parley import fixed_values as fv
from parley.functions.pii import pii_columns, with_hardened_redaction, with_names_redacted


def redact(spark, text, mode="token", profile="full"):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return pii_columns(df, "t", profile, mode).first()


@pytest.mark.parametrize("text,expected", [
    ("Contact: john@example.com", "Contact: [EMAIL]"),
    ("call 555-123-4567 or (555) 123-4567", "call [PHONE] or [PHONE]"),
    ("SSN 123-45-6789", "SSN [SSN]"),
    ("SSN 000-12-3456 666-12-3456 900-12-3456 123-00-3456 123-45-0000",
     "SSN 000-12-3456 666-12-3456 900-12-3456 123-00-3456 123-45-0000"),
    ("card 4111111111111111 not 4111111111111112", "card [CARD] not 4111111111111112"),
    ("born 12/31/1980", "born [DOB]"),
    ("born 12/31/2099", "born 12/31/2099"),
    ("MRN: ABC123456", "MRN: [MRN]"),
    ("ip 10.0.0.1 and 300.1.1.1", "ip [IP] and 300.1.1.1"),
    ("at 12 Long Oak Street, near", "at [ADDRESS], near"),
    ("has covid-19 and Covid", "has [CONDITION] and [CONDITION]"),
    (None, ""),
])
def test_tokens(spark, text, expected):
    assert redact(spark, text).redacted_text == expected


def test_modes(spark):
    t = "Contact: john@example.com"
    h = hashlib.sha256(b"john@example.com").hexdigest()[:8]
    assert redact(spark, t, "hash").redacted_text == f"Contact: [EMAIL:{h}]"
    assert redact(spark, t, "other").redacted_text == f"Contact: [EMAIL:{h}]"
    assert redact(spark, t, "mask").redacted_text == "Contact: [EMAIL:**********]"
    assert redact(spark, t, "remove").redacted_text == "Contact: "


def test_counts_repeats(spark):
    row = redact(spark, "a@b.com a@b.com 10.0.0.1", "hash")
    assert row.pii_counts == {"emails": 2, "ip_addresses": 1}
    assert (row.total_items, row.pii_detected) == (3, True)
    none = redact(spark, "nothing here")
    assert (none.pii_counts, none.total_items, none.pii_detected) == ({}, 0, False)


def test_redaction_is_idempotent_and_complete(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    once = pii_columns(df, "text", "validated", "token").select("doc_id", "redacted_text", "total_items")
    rows = {r.doc_id: r for r in once.collect()}
    again = pii_columns(once.select("doc_id", "redacted_text").withColumnRenamed("redacted_text", "t"), "t",
                        "validated", "token")
    for r in again.collect():
        assert r.redacted_text == rows[r.doc_id].redacted_text
        assert not re.search(fv.EMAIL, r.redacted_text)


def test_filter_on_result_keeps_the_plan_small(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii_columns(df, "text", "full").where("pii_detected").select("doc_id")._jdf.queryExecution().optimizedPlan()
    assert len(plan.toString()) < 200_000


def test_hardened(spark):
    df = spark.createDataFrame([(1, "Patient ID: AB12345 at 5 High Way, mail a@b.org")], "id int, t string")
    assert with_hardened_redaction(df, "t", "token").first().redacted_text == "[MRN] at [ADDR], mail [EMAIL]"
    assert "[EMAIL:REDACTED]" in with_hardened_redaction(df, "t", "mask").first().redacted_text


def test_names(spark):
    df = spark.createDataFrame([(1, "Patient John Smith, MRN"), (2, "nobody")], "id int, t string")
    names = spark.createDataFrame([("John",), ("Smith",)], "n string")
    got = {r.id: r.redacted_text for r in with_names_redacted(df, "id", "t", names, "n", "token").collect()}
    assert got == {1: "Patient [NAME] [NAME], MRN", 2: "nobody"}
