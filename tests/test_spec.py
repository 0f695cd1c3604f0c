import pytest
from pyspark.sql import types as T

from strata.plans.retail import retail_specs
from strata.spec import SpecError, TableSpec, load_specs, to_struct


def test_types_are_mapped_and_nullable():
    names = ["string", "integer", "double", "date", "timestamp"]
    struct = to_struct([{"name": f"c_{n}", "type": n} for n in names])
    assert [f.dataType for f in struct] == [
        T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType(), T.TimestampType(),
    ]
    assert all(f.nullable for f in struct)


def test_unknown_type_is_refused():
    with pytest.raises(SpecError, match="decimal"):
        to_struct([{"name": "amount", "type": "decimal"}])


def test_retail_tables():
    specs = retail_specs()
    assert list(specs) == [
        "sales", "customer", "product", "store", "supplier", "inventory", "promotions",
        "online_orders", "shipping", "returns",
    ]
    assert [n for n, s in specs.items() if s.keeps_history] == ["customer", "product"]
    assert specs["inventory"].business_key == ("store_id", "stock_code", "snapshot_date")
    assert specs["sales"].partition_by == ("sale_date",)
    assert specs["sales"].schema["invoice_date"].dataType == T.TimestampType()


def test_specs_are_checked():
    columns = ({"name": "a", "type": "string"},)
    with pytest.raises(SpecError, match="undeclared"):
        TableSpec("t", columns, ("b",))
    with pytest.raises(SpecError, match="history"):
        TableSpec("t", columns, ("a",), scd_type=2)
    with pytest.raises(SpecError, match="key"):
        TableSpec("t", columns, ())
    assert load_specs("tables: {}") == {}
