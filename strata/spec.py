"""Declarative table specifications."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import yaml
from pyspark.sql import types as T

# The type names a specification may use.
SPEC_TYPES = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


PERIODS = ("day", "month", "year")


class SpecError(ValueError):
    """A table specification cannot be used."""


def to_struct(columns: list[dict[str, str]]) -> T.StructType:
    """Turn ``[{name, type}, ...]`` into an all-nullable ``StructType``."""
    struct = T.StructType()
    for column in columns:
        if column["type"] not in SPEC_TYPES:
            raise SpecError(
                f"column {column['name']!r} has unsupported type {column['type']!r}; "
                f"use one of {', '.join(SPEC_TYPES)}"
            )
        struct = struct.add(column["name"], SPEC_TYPES[column["type"]], True)
    return struct


@dataclass(frozen=True)
class TableSpec:
    """What one table looks like and how its layers are maintained.

    ``scd_type`` 2 keeps history; anything else is maintained as an upsert by business key.
    ``partition_period`` may be ``"month"`` or ``"year"`` where ``partition_by`` names one date column:
    a directory then holds that period, for tables with few rows a day.
    """

    name: str
    columns: tuple[dict[str, str], ...]
    business_key: tuple[str, ...]
    source_path: str | None = None
    scd_type: int | None = None
    tracked_columns: tuple[str, ...] = ()
    surrogate_key_col: str | None = None
    partition_by: tuple[str, ...] = ()
    dq_rules: tuple[dict[str, Any], ...] = ()
    partition_period: str = "day"

    def __post_init__(self) -> None:
        declared = {column["name"] for column in self.columns}
        for role in ("business_key", "tracked_columns", "partition_by"):
            unknown = [c for c in getattr(self, role) if c not in declared]
            if unknown:
                raise SpecError(f"{self.name}: {role} names undeclared columns {unknown}")
        if self.partition_period not in PERIODS:
            raise SpecError(f"{self.name}: partition_period must be one of {', '.join(PERIODS)}")
        if self.partition_period != "day":
            kinds = {c["name"]: c["type"] for c in self.columns}
            if [kinds[c] for c in self.partition_by] != ["date"]:
                raise SpecError(f"{self.name}: a partition_period needs one date in partition_by")
        if not self.business_key:
            raise SpecError(f"{self.name}: a business key is required")
        if self.scd_type == 2 and not (self.tracked_columns and self.surrogate_key_col):
            raise SpecError(f"{self.name}: history needs tracked_columns and surrogate_key_col")

    @property
    def schema(self) -> T.StructType:
        return to_struct(list(self.columns))

    @property
    def keeps_history(self) -> bool:
        return self.scd_type == 2

    @classmethod
    def from_dict(cls, name: str, entry: dict[str, Any]) -> TableSpec:
        return cls(
            name=name,
            columns=tuple(entry["schema"]),
            business_key=tuple(entry["business_key"]),
            source_path=entry.get("source_path"),
            scd_type=entry.get("scd_type"),
            tracked_columns=tuple(entry.get("tracked_columns") or ()),
            surrogate_key_col=entry.get("surrogate_key_col"),
            partition_by=tuple(entry.get("partition_by") or ()),
            dq_rules=tuple(entry.get("dq_rules") or ()),
            partition_period=entry.get("partition_period", "day"),
        )


def load_specs(text: str) -> dict[str, TableSpec]:
    """Read a YAML document with a top-level ``tables`` mapping, in document order."""
    tables = (yaml.safe_load(text) or {}).get("tables") or {}
    return {name: TableSpec.from_dict(name, entry) for name, entry in tables.items()}
