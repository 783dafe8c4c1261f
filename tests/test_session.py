"""Written tables and the scopes that drop them."""

import os

import pytest
from townrisk.session import shared_folder, shared_table, table_scope


def tables(spark, name):
    folder = f"{shared_folder(spark)}/tables"
    return [f for f in os.listdir(folder) if f.startswith(name + "-")] if os.path.isdir(folder) else []


def test_scope_drops_all_but_kept(spark):
    with table_scope(spark):
        with table_scope(spark):
            shared_table(spark.range(5), "scope-spent")
            kept = shared_table(spark.range(7), "scope-kept", keep=True)
        assert kept.count() == 7 and not tables(spark, "scope-spent")
    assert not tables(spark, "scope-kept")
    stays = shared_table(spark.range(3), "scope-none")
    with table_scope(spark):
        also = shared_table(spark.range(4), "scope-outer", keep=True)
    assert stays.count() == 3 and also.count() == 4


def test_scope_drops_after_errors(spark):
    with pytest.raises(ValueError, match="stop"), table_scope(spark):
        shared_table(spark.range(5), "scope-failed")
        raise ValueError("stop")
    assert not tables(spark, "scope-failed")
