"""Every registered query of the library against its SQL, and the driver's entry."""

import duckdb
import pytest

import __spark_entry__
from flowloom.plans import fact_queries, queries  # noqa: F401  both add to the same lists
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(
    "orders",
    [
        pytest.param("(10, 1), (11, 1)", id="more parts than a flow has by default"),
        pytest.param("(10, 1), (20, 2)", id="a customer without lines"),
        pytest.param("(5000000000, 3)", id="a key beyond 32 bits"),
    ],
)
def test_extract_equals_its_sql_for_odd_orders(spark, tmp_path, orders):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey FROM (VALUES {orders}) v(o_orderkey, o_custkey)")
    con.execute("CREATE TABLE lineitem AS SELECT 10::BIGINT + i // 5100 AS l_orderkey, i % 5200 AS l_partkey FROM range(5200) r(i) UNION ALL VALUES (5000000000, 7)")
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'Brand#' || i % 5 AS p_brand, 'TYPE ' || i % 7 AS p_type, CAST(i % 50 AS INTEGER) AS p_size FROM range(5200) r(i)")
    if "20" in orders:
        con.execute("DELETE FROM lineitem WHERE l_partkey >= 100")
    for name in ("orders", "lineitem", "part"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    same_rows(queries.q42_extract(spark, str(tmp_path)), con, queries.SQL["q42_extract"])
