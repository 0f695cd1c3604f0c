"""Data-quality rules: named Column predicates built from configuration entries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.columns import any_null


@dataclass(frozen=True)
class Rule:
    """``holds`` is never NULL: a predicate that cannot be decided counts as failed."""

    kind: str
    column: str
    holds: Column

    @property
    def label(self) -> str:
        return f"{self.kind}({self.column})"


def not_null(column: str, as_of: dt.date | None = None) -> Column:
    return F.col(column).isNotNull()


def non_negative(column: str, as_of: dt.date | None = None) -> Column:
    return F.col(column).isNull() | (F.col(column) >= 0)


def allowed_values(column: str, as_of: dt.date | None = None, *, allowed: list[Any]) -> Column:
    members = [value for value in allowed if value is not None]
    return F.col(column).isNull() | F.col(column).isin(members)


def no_future_date(column: str, as_of: dt.date | None = None) -> Column:
    today = F.current_date() if as_of is None else F.lit(as_of)
    return F.col(column).isNull() | (F.col(column) <= today)


#: Rule name -> predicate factory ``(column, as_of, **parameters)``; users may add their own.
RULES: dict[str, Callable[..., Column]] = {
    "not_null": not_null,
    "non_negative": non_negative,
    "allowed_values": allowed_values,
    "no_future_date": no_future_date,
}


def build(config: dict[str, Any], as_of: dt.date | None = None) -> Rule:
    """A rule from ``{type, column, **parameters}``."""
    parameters = dict(config)
    kind, column = parameters.pop("type"), parameters.pop("column")
    if kind not in RULES:
        raise ValueError(f"unknown rule {kind!r}; known rules: {', '.join(sorted(RULES))}")
    holds = RULES[kind](column, as_of, **parameters)
    return Rule(kind, column, F.coalesce(holds, F.lit(False)))


def build_all(configs: Iterable[dict[str, Any]], as_of: dt.date | None = None) -> list[Rule]:
    return [build(config, as_of) for config in configs]


def key_present(business_key: Iterable[str]) -> Rule:
    """Rows whose key has a NULL part can never be merged; they go to quarantine instead."""
    key = list(business_key)
    return Rule("business_key", ",".join(key), ~any_null(key))


def well_formed(corrupt_column: str) -> Rule:
    """Rows the CSV parser could not read with the declared schema."""
    return Rule("well_formed", "row", F.col(corrupt_column).isNull())
