"""Every registered query against its SQL, on the small tables."""

import duckdb
import pandas as pd
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def plain(frame):
    def text(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        return f"{float(x):.6g}" if hasattr(x, "__float__") and not isinstance(x, str) else str(x)

    return sorted(map(tuple, frame[sorted(frame.columns)].map(text).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), oracle.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["container_lift", "merge_evidence", "scalar_conflict_winner", "strata_rollup"])
def test_order_of_rows_does_not_matter(spark, tmp_path, name):
    for table in ("lineitem", "orders", "customer", "supplier", "nation", "region"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(5).write.parquet(f"{tmp_path}/{table}.parquet")
    assert plain(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(registry.QUERIES[name](spark, SF).toPandas())
