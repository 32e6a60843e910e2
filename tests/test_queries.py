"""Every query with SQL against DuckDB, and the shape of the others."""

import pytest
from oracle import assert_same

from terrakin.plans.oracle import ORACLE_SQL
from terrakin.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name, rows", [("spectral_init", 500), ("embed_level", 100), ("pca_2", 500), ("kmeans_selection", 500), ("umap_flat", 500)])
def test_rows(spark, name, rows):
    out = QUERIES[name](spark, SF).toPandas()
    assert len(out) == rows
    assert not out.isna().any().any()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["i", "j", "w"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
