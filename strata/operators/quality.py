"""Data quality: flag each row once, then split, count and profile."""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.rules import Rule

FAILED = "_dq_failed_rules"

# The pass rate below which a batch is reported as a warning, and the
# default ceiling for the share of NULLs in a column, both in percent.
HEALTHY_PASS_RATE = 95.0
MAX_NULL_PERCENT = 5.0


@dataclass(frozen=True)
class Validated:
    """``flagged`` is the input plus the labels of the failed rules of every row."""

    flagged: DataFrame
    valid: DataFrame
    invalid: DataFrame


def failed_rules(rules: list[Rule]) -> Column:
    """Labels of the rules a row fails, in rule order; an empty array for a good row.

    Arrays of one label or none are joined, which stays inside codegen; dropping NULLs from an array
    of all labels does not.
    """
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.when(~r.holds, F.array(F.lit(r.label))).otherwise(none) for r in rules])


def validate(df: DataFrame, rules: list[Rule]) -> Validated:
    """Split rows by the rules. Every input row is on exactly one side."""
    flagged = df.withColumn(FAILED, failed_rules(rules))
    if not rules:
        return Validated(flagged, df, flagged.where(F.lit(False)))
    good = rules[0].holds
    for rule in rules[1:]:
        good = good & rule.holds
    return Validated(flagged, df.where(good), flagged.where(~good))


def rule_counts(rules: list[Rule]) -> list[Column]:
    """Aggregates for one pass: rows, good rows and failures per rule.

    They fit into ``agg`` as well as into ``DataFrame.observe`` on a write.
    """
    good = F.lit(True)
    for rule in rules:
        good = good & rule.holds
    return [
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(good).alias("valid_count"),
        *[F.count_if(~r.holds).alias(f"failed_{i}") for i, r in enumerate(rules)],
    ]


def pass_rate(valid: Column, total: Column) -> Column:
    return F.when(total > 0, valid * F.lit(100.0) / total).otherwise(F.lit(100.0))


def dq_summary(df: DataFrame, rules: list[Rule], table: str) -> DataFrame:
    """One row: counts, pass rate and health level of a table."""
    total, valid = F.col("total_count"), F.col("valid_count")
    rate = pass_rate(valid, total)
    return df.agg(*rule_counts(rules)).select(
        F.lit(table).alias("table_name"),
        total,
        valid,
        (total - valid).alias("invalid_count"),
        rate.alias("pass_rate"),
        F.when(rate >= HEALTHY_PASS_RATE, "INFO").otherwise("WARNING").alias("level"),
    )


def dq_violations(df: DataFrame, rules: list[Rule], table: str) -> DataFrame:
    """One row per rule that failed at least once, from a single pass over the data."""
    if not rules:
        raise ValueError("no rules to count")
    entries = [
        F.struct(
            F.lit(r.kind).alias("rule_name"),
            F.lit(r.column).alias("column_name"),
            F.col(f"failed_{i}").alias("failed_count"),
        )
        for i, r in enumerate(rules)
    ]
    return (
        df.agg(*rule_counts(rules))
        .select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))
        .where("failed_count > 0")
    )


def null_profile(
    df: DataFrame, columns: list[str] | None = None, limit: float = MAX_NULL_PERCENT
) -> DataFrame:
    """Share of NULLs per column in percent against a ceiling, from a single pass."""
    columns = columns or df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(c)).alias(f"present_{i}") for i, c in enumerate(columns)],
    )
    rows = F.col("rows")
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            (rows - F.col(f"present_{i}")).alias("null_count"),
            F.when(rows > 0, (rows - F.col(f"present_{i}")) * F.lit(100.0) / rows)
            .otherwise(F.lit(0.0))
            .alias("null_percent"),
        )
        for i, c in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*entries))).withColumn(
        "within_limit", F.col("null_percent") <= limit
    )


@dataclass(frozen=True)
class Gate:
    """What a batch has to satisfy as a whole before anybody sees a row of it.

    At most ``max_null_percent`` of each column may be NULL, of ``columns`` or else of all that are
    declared, and with ``fail_on_schema_mismatch`` no row may be malformed.
    """

    max_null_percent: float = MAX_NULL_PERCENT
    fail_on_schema_mismatch: bool = True
    columns: tuple[str, ...] | None = None

    @classmethod
    def from_yaml(cls, text: str) -> Gate:
        """From the ``data_quality`` part of a configuration; what it leaves out has its default."""
        entry = (yaml.safe_load(text) or {}).get("data_quality") or {}
        return cls(
            float(entry.get("max_null_percentage_allowed", MAX_NULL_PERCENT)),
            bool(entry.get("fail_on_schema_mismatch", True)),
        )

    def metrics(self, declared: list[str], malformed: str) -> list[Column]:
        """Aggregates for the write of the batch; NULLs of malformed rows count as such only."""
        well_formed = F.col(malformed).isNull()
        return [
            F.count(F.lit(1)).alias("gate_rows"),
            F.count_if(~well_formed).alias("gate_malformed"),
            *[
                F.count_if(well_formed & F.col(c).isNull()).alias(f"gate_{i}")
                for i, c in enumerate(self.columns or declared)
            ],
        ]

    def faults(self, observed: dict, declared: list[str]) -> list[str]:
        """Why the batch has to be held; empty if it may be published."""
        rows, found = observed["gate_rows"] or 0, []
        if self.fail_on_schema_mismatch and observed["gate_malformed"]:
            found.append(f"{observed['gate_malformed']} malformed rows")
        for i, column in enumerate(self.columns or declared):
            share = 100.0 * observed[f"gate_{i}"] / rows if rows else 0.0
            if share > self.max_null_percent:
                found.append(f"{column}: {share:.2f} % NULL, at most {self.max_null_percent:.2f} %")
        return found


def quarantine_report(quarantined: DataFrame, table: str) -> DataFrame:
    """Rejected rows per rule of one quarantine table."""
    return (
        quarantined.select(F.explode(FAILED).alias("failed_rule"))
        .groupBy("failed_rule")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(table).alias("table_name"), "failed_rule", "row_count")
    )
