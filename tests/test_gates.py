"""Batches held back as a whole, and rejected rows that come back."""

import datetime as dt
from dataclasses import replace

import pytest
from rows import as_rows

from strata.operators.quality import Gate
from strata.plans import layers
from strata.spec import TableSpec

DAY1, DAY2, DAY3 = dt.date(2026, 7, 1), dt.date(2026, 7, 2), dt.date(2026, 7, 3)
STOCK = TableSpec(
    "stock",
    tuple({"name": n, "type": t} for n, t in (("code", "string"), ("n", "integer"), ("day", "date"))),
    ("code",),
    dq_rules=({"type": "non_negative", "column": "n"},),
)
TIERS = TableSpec(
    "tiers",
    ({"name": "who", "type": "string"}, {"name": "tier", "type": "string"}),
    ("who",),
    scd_type=2,
    tracked_columns=("tier",),
    surrogate_key_col="sk",
    dq_rules=({"type": "allowed_values", "column": "tier", "allowed": ["gold"]},),
)


@pytest.fixture
def land(tables, tmp_path):
    def put(spec, day, *lines, **options):
        folder = tmp_path / "landing" / spec.name
        folder.mkdir(parents=True, exist_ok=True)
        header = ",".join(spec.schema.names)
        (folder / f"{day}-{len(list(folder.iterdir()))}.csv").write_text("\n".join([header, *lines]) + "\n")
        return layers.run_bronze(tables, [spec], str(tmp_path / "landing"), day, **options)[spec.name]

    return put


def test_gate_settings():
    gate = Gate.from_yaml("data_quality:\n  fail_on_schema_mismatch: false\n  max_null_percentage_allowed: 12.5\n")
    assert (gate.fail_on_schema_mismatch, gate.max_null_percent) == (False, 12.5)
    assert Gate.from_yaml("") == Gate()


def test_held_batches_are_released_or_discarded(tables, land):
    assert "skipped" not in land(STOCK, DAY1, "A,1,2026-07-01", gate=Gate())
    result = land(STOCK, DAY2, "B,2,", "C,-3,2026-07-02", gate=Gate())
    assert result["skipped"] == "day: 50.00 % NULL, at most 5.00 %"
    assert as_rows(tables.read("bronze", "stock"), "code") == [("A",)]
    assert not tables.exists("quarantine", "stock")
    assert layers.run_metrics(tables, [result]).first()["skipped"] == result["skipped"]
    # Its files are not read again, and pruning leaves them.
    assert land(STOCK, DAY2, "D,4,2026-07-02", gate=Gate())["total_count"] == 1
    tables.prune("bronze", "stock")
    (generation,) = layers.held_batches(tables, STOCK)
    layers.release_held(tables, STOCK, generation)
    assert as_rows(tables.read("bronze", "stock"), "code") == [("A",), ("B",), ("D",)]
    assert as_rows(tables.read("quarantine", "stock"), "code") == [("C",)]
    assert layers.held_batches(tables, STOCK) == []
    malformed = land(STOCK, DAY3, "E,many,2026-07-03", "F,6,2026-07-03", gate=Gate())
    assert malformed["skipped"] == "1 malformed rows"
    layers.discard_held(tables, STOCK, layers.held_batches(tables, STOCK)[0])
    assert tables.read("bronze", "stock").count() == 3
    loose = Gate(fail_on_schema_mismatch=False, columns=("code",))
    assert "skipped" not in land(STOCK, DAY3, "G,none,", "H,7,", gate=loose)
    assert as_rows(tables.read("quarantine", "stock"), "code") == [("C",), ("G",)]


def test_an_empty_batch_passes(land):
    assert "skipped" not in land(STOCK, DAY1, gate=Gate())


def test_replayed_rows_do_not_replace_newer_ones(tables, land):
    land(STOCK, DAY1, "A,-1,2026-07-01", "B,-2,2026-07-01", "C,3,2026-07-01")
    land(STOCK, DAY2, "A,10,2026-07-02")
    layers.run_silver(tables, [STOCK], DAY2)
    loose = replace(STOCK, dq_rules=())
    assert layers.replay_quarantine(tables, loose, DAY3)["valid_count"] == 2
    assert layers.replay_quarantine(tables, loose, DAY3)["valid_count"] == 0
    assert tables.read("bronze", "stock").count() == 4 and tables.read("quarantine", "stock").isEmpty()
    layers.run_silver(tables, [loose], DAY3)
    assert as_rows(tables.read("silver", "stock"), "code", "n") == [("A", 10), ("B", -2), ("C", 3)]


def test_replayed_versions_take_their_place(tables, land):
    land(TIERS, DAY1, "u,silver", "w,gold")
    land(TIERS, DAY2, "u,gold")
    layers.run_silver(tables, [TIERS], DAY2)
    loose = replace(TIERS, dq_rules=())
    layers.replay_quarantine(tables, loose, DAY3)
    layers.run_silver(tables, [loose], DAY3)
    columns = ("who", "tier", "effective_start_date", "effective_end_date")
    assert as_rows(tables.read("silver", "tiers"), *columns) == [
        ("u", "gold", DAY2, None), ("u", "silver", DAY1, DAY2), ("w", "gold", DAY1, None)
    ]


def test_a_replay_that_stopped_goes_on(tables, land, monkeypatch):
    land(STOCK, DAY1, "A,-1,2026-07-01", ",-2,2026-07-01", "C,3,2026-07-01")
    publish = tables._publish

    def fail(layer, table, state):
        if layer == "quarantine":
            raise OSError("lost")
        publish(layer, table, state)

    monkeypatch.setattr(tables, "_publish", fail)
    loose = replace(STOCK, dq_rules=())
    with pytest.raises(OSError):
        layers.replay_quarantine(tables, loose, DAY2)
    monkeypatch.setattr(tables, "_publish", publish)
    layers.replay_quarantine(tables, loose, DAY2)
    assert as_rows(tables.read("bronze", "stock"), "code", "n") == [("A", -1), ("C", 3)]
    assert as_rows(tables.read("quarantine", "stock"), "code", "n") == [(None, -2)]
    assert layers.replay_quarantine(tables, loose, DAY2)["valid_count"] == 0
