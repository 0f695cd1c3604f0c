"""Tables addressed by name in the session catalog, one database per layer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import materialize
from strata.sources.tables import LAYERS


class CatalogTables:
    """Managed Parquet tables behind views.

    ``publish`` writes a new table and then points the view of the public name at it, so it may
    read the table it replaces and readers never see half of it. The version before stays for
    readers that have begun; older ones are dropped. ``append`` adds to the table the view
    currently shows. A table keeps its partition columns unless others are named.
    """

    def __init__(self, spark: SparkSession, prefix: str = ""):
        self.spark = spark
        self.prefix = prefix

    def database(self, layer: str) -> str:
        return f"{self.prefix}{layer}"

    def name(self, layer: str, table: str) -> str:
        return f"{self.database(layer)}.{table}"

    def init(self, layers: Iterable[str] = LAYERS) -> None:
        for layer in layers:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database(layer)}")

    def drop(self, layer: str) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database(layer)} CASCADE")

    def list(self, layer: str) -> list[str]:
        tables = self.spark.catalog.listTables(self.database(layer))
        return sorted(t.name for t in tables if t.tableType == "VIEW" and not t.isTemporary)

    def exists(self, layer: str, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(layer, table))

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.name(layer, table))

    def publish(
        self, df: DataFrame, layer: str, table: str, partition_by: Iterable[str] | None = None
    ) -> None:
        latest = self._latest(layer, table)
        if partition_by is None:
            partition_by = self.partition_columns(layer, table) if latest else ()
        stored = f"{self.name(layer, table)}__{latest + 1}"
        _partitioned(df.write.mode("errorifexists").format("parquet"), partition_by).saveAsTable(stored)
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self.name(layer, table)} AS SELECT * FROM {stored}"
        )
        for version in self._versions(layer, table):
            if version < latest:
                self.spark.sql(f"DROP TABLE {self.name(layer, table)}__{version}")

    def append(
        self, df: DataFrame, layer: str, table: str, partition_by: Iterable[str] | None = None
    ) -> None:
        if not self.exists(layer, table):
            self.publish(df, layer, table, partition_by)
            return
        columns = self.partition_columns(layer, table) if partition_by is None else partition_by
        stored = f"{self.name(layer, table)}__{self._latest(layer, table)}"
        _partitioned(df.write.mode("append").format("parquet"), columns).saveAsTable(stored)
        self.spark.catalog.refreshTable(self.name(layer, table))

    def partition_columns(self, layer: str, table: str) -> list[str]:
        stored = f"{self.name(layer, table)}__{self._latest(layer, table)}"
        return [c.name for c in self.spark.catalog.listColumns(stored) if c.isPartition]

    def replace_partition(
        self,
        df: DataFrame | None,
        layer: str,
        table: str,
        column: str,
        value: object,
    ) -> None:
        """Give one value of a column other rows (or none).

        If the column is the table's only partition column, that partition alone is dropped and
        written: no other file is touched, but a reader in between sees the value without rows.
        Otherwise the table is published anew.
        """
        if value is not None and self.partition_columns(layer, table) == [column]:
            stored = f"{self.name(layer, table)}__{self._latest(layer, table)}"
            fresh = None if df is None else materialize(df)  # it may read what is dropped
            text = str(value).replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"ALTER TABLE {stored} DROP IF EXISTS PARTITION ({column} = '{text}')")
            self.spark.catalog.refreshTable(self.name(layer, table))
            if fresh is not None:
                self.append(fresh, layer, table)
            return
        rest = self.read(layer, table).where(~F.col(column).eqNullSafe(F.lit(value)))
        self.publish(rest if df is None else rest.unionByName(df), layer, table)

    def _versions(self, layer: str, table: str) -> list[int]:
        mark = f"{table}__"
        names = [t.name for t in self.spark.catalog.listTables(self.database(layer))]
        return [int(n[len(mark) :]) for n in names if n.startswith(mark) and n[len(mark) :].isdigit()]

    def _latest(self, layer: str, table: str) -> int:
        return max(self._versions(layer, table), default=0)


def _partitioned(writer, columns: Iterable[str]):
    columns = list(columns)
    return writer.partitionBy(*columns) if columns else writer
