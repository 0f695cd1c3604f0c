import datetime as dt

import pytest
from rows import as_rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strata.functions import rules as R
from strata.operators.quality import (
    FAILED,
    dq_summary,
    dq_violations,
    null_profile,
    quarantine_report,
    rule_counts,
    validate,
)

INVOICES = "invoice_id string, stock_code string, quantity bigint"
INVOICE_RULES = [
    {"type": "not_null", "column": "stock_code"},
    {"type": "non_negative", "column": "quantity"},
]


@pytest.fixture
def invoices(frame):
    return frame(INVOICES, ("INV001", "A100", 5), ("INV002", None, 3), ("INV003", "A102", -1))


def test_split_and_reasons(invoices):
    result = validate(invoices, R.build_all(INVOICE_RULES))
    assert as_rows(result.valid) == [("INV001", "A100", 5)]
    assert as_rows(result.invalid, "invoice_id", FAILED) == [
        ("INV002", ["not_null(stock_code)"]),
        ("INV003", ["non_negative(quantity)"]),
    ]


def test_counts_come_from_one_aggregate(invoices):
    rules = R.build_all(INVOICE_RULES)
    summary = dq_summary(invoices, rules, "sales").first()
    assert (summary.total_count, summary.valid_count, summary.invalid_count) == (3, 1, 2)
    assert summary.pass_rate == pytest.approx(100 / 3) and summary.level == "WARNING"
    assert as_rows(dq_violations(invoices, rules, "sales"), "rule_name", "failed_count") == [
        ("non_negative", 1), ("not_null", 1),
    ]


def test_counts_can_be_observed_on_a_write(invoices, tmp_path):
    seen = Observation()
    counted = invoices.observe(seen, *rule_counts(R.build_all(INVOICE_RULES)))
    counted.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"total_count": 3, "valid_count": 1, "failed_0": 1, "failed_1": 1}


def test_only_failing_rules_are_violations(frame):
    good = frame(INVOICES, ("INV001", "A100", 5))
    assert dq_violations(good, R.build_all(INVOICE_RULES), "sales").isEmpty()


def test_allowed_values(frame):
    df = frame("id string, country string", ("1", "United Kingdom"), ("2", "Atlantis"), ("3", None))
    config = {"type": "allowed_values", "column": "country", "allowed": ["United Kingdom"]}
    result = validate(df, [R.build(config)])
    assert as_rows(result.valid, "id") == [("1",), ("3",)]
    assert as_rows(result.invalid, "id") == [("2",)]


def test_null_in_the_allowed_list_loses_no_row(frame):
    df = frame("id string, country string", ("1", "France"), ("2", "Atlantis"))
    config = {"type": "allowed_values", "column": "country", "allowed": ["France", None]}
    result = validate(df, [R.build(config)])
    assert (result.valid.count(), result.invalid.count()) == (1, 1)


def test_no_future_date(frame):
    df = frame("d date", ("2026-01-01",), ("2026-01-02",), (None,))
    rule = R.build({"type": "no_future_date", "column": "d"}, as_of=dt.date(2026, 1, 1))
    assert validate(df, [rule]).invalid.count() == 1
    today = R.build({"type": "no_future_date", "column": "d"})
    assert "current_date" in str(today.holds)


def test_nan_and_null_are_not_negative(frame):
    df = frame("v double", (float("nan"),), (None,), (0.0,), (-0.5,))
    rule = R.build({"type": "non_negative", "column": "v"})
    assert validate(df, [rule]).invalid.count() == 1


def test_empty_frame_passes(frame):
    empty = frame("invoice_id string, quantity int")
    summary = dq_summary(empty, R.build_all([{"type": "not_null", "column": "invoice_id"}]), "t")
    row = summary.first()
    assert (row.valid_count, row.invalid_count, row.pass_rate, row.level) == (0, 0, 100.0, "INFO")


def test_all_null_fails(frame):
    df = frame("invoice_id string, customer_id string", ("1", None), ("2", None), ("3", None))
    rules = R.build_all([{"type": "not_null", "column": "customer_id"}])
    row = dq_summary(df, rules, "t").first()
    assert (row.valid_count, row.invalid_count, row.pass_rate) == (0, 3, 0.0)


def test_no_rules_keep_everything(invoices):
    result = validate(invoices, [])
    assert result.valid.count() == 3 and result.invalid.count() == 0
    assert result.valid.schema == invoices.schema
    assert result.invalid.columns == [*invoices.columns, FAILED]


def test_registry_is_open_and_checked(frame, monkeypatch):
    with pytest.raises(ValueError, match="unknown rule"):
        R.build({"type": "is_even", "column": "n"})
    monkeypatch.setitem(
        R.RULES, "is_even", lambda column, as_of=None, by=2: F.col(column) % by == 0
    )
    rule = R.build({"type": "is_even", "column": "n", "by": 2})
    df = frame("n int", (1,), (2,), (None,))
    # An undecided predicate counts as failed: valid and invalid always add up to the input.
    result = validate(df, [rule])
    assert (result.valid.count(), result.invalid.count()) == (1, 2)


def test_health_threshold(frame):
    rules = R.build_all([{"type": "non_negative", "column": "n"}])
    exactly = frame("n int", *[(1,)] * 19, (-1,))
    assert dq_summary(exactly, rules, "t").first().level == "INFO"
    below = frame("n int", *[(1,)] * 18, (-1,))
    assert dq_summary(below, rules, "t").first().level == "WARNING"


def test_null_profile(frame):
    df = frame("a int, b int", *[(1, 1)] * 19, (1, None))
    assert as_rows(null_profile(df)) == [("a", 0, 0.0, True), ("b", 1, 5.0, True)]
    assert as_rows(null_profile(df, ["b"], limit=4.0)) == [("b", 1, 5.0, False)]
    assert as_rows(null_profile(df.limit(0), ["a"])) == [("a", 0, 0.0, True)]


def test_quarantine_report(invoices):
    rejected = validate(invoices, R.build_all(INVOICE_RULES)).invalid
    assert as_rows(quarantine_report(rejected, "sales")) == [
        ("sales", "non_negative(quantity)", 1), ("sales", "not_null(stock_code)", 1),
    ]


def test_flags_stay_inside_codegen(frame):
    """Labels come from joined arrays; a lambda over an array of all labels would be interpreted."""
    rules = [R.build({"type": "not_null", "column": c}) for c in ("a", "b", "a")]
    flagged = validate(frame("a int, b int", (1, 1), (None, 1), (None, None)), rules).flagged
    assert sorted(r[FAILED] for r in flagged.collect()) == [
        [], ["not_null(a)", "not_null(a)"], ["not_null(a)", "not_null(b)", "not_null(a)"],
    ]
    assert "lambda" not in flagged._jdf.queryExecution().executedPlan().toString()
