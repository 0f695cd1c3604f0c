"""strata: layered batch-table pipelines written with the Spark DataFrame API."""

from strata.spec import TableSpec, load_specs

__all__ = ["TableSpec", "load_specs"]
