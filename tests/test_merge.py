import pytest
from rows import as_rows

from strata.operators.merge import DuplicateKeys, merge_upsert

SCHEMA = "invoice_id string, quantity bigint"


def test_first_load_is_the_source(frame):
    assert as_rows(merge_upsert(frame(SCHEMA, ("INV001", 5)), None, ["invoice_id"])) == [("INV001", 5)]


def test_update_insert_keep(frame):
    target = frame(SCHEMA, ("INV000", 1), ("INV001", 5))
    source = frame(SCHEMA, ("INV001", 99), ("INV002", 3))
    merged = merge_upsert(source, target, ["invoice_id"])
    assert as_rows(merged) == [("INV000", 1), ("INV001", 99), ("INV002", 3)]
    again = merge_upsert(source, merged, ["invoice_id"])
    assert as_rows(again) == as_rows(merged)


def test_duplicate_source_keys_are_an_error(frame):
    source = frame(SCHEMA, ("INV001", 1), ("INV001", 2))
    with pytest.raises(DuplicateKeys, match="INV001"):
        merge_upsert(source, None, ["invoice_id"])


def test_null_keys_never_match(frame):
    target = frame(SCHEMA, (None, 1))
    assert as_rows(merge_upsert(frame(SCHEMA, (None, 2)), target, ["invoice_id"])) == [
        (None, 1), (None, 2),
    ]


def test_columns_are_matched_by_name(frame):
    target = frame(SCHEMA, ("INV001", 5))
    source = frame("quantity bigint, invoice_id string", (7, "INV001"))
    assert as_rows(merge_upsert(source, target, ["invoice_id"])) == [("INV001", 7)]


def test_older_rows_lose_if_asked(frame):
    schema = "k string, v string, day date"
    target = frame(schema, ("a", "new", "2026-02-01"), ("b", "old", "2026-01-01"))
    source = frame(
        schema, ("a", "replayed", "2026-01-15"), ("b", "newer", "2026-01-15"), ("c", "c", "2026-01-01")
    )
    assert as_rows(merge_upsert(source, target, ["k"], newer_than="day"), "k", "v") == [
        ("a", "new"), ("b", "newer"), ("c", "c"),
    ]
    assert as_rows(merge_upsert(source, target, ["k"]), "k", "v")[0] == ("a", "replayed")
