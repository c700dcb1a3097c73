"""Keys that a fixed value of a query's made-up lines could meet."""

import duckdb

from tessera.plans import project, registry  # noqa: F401  they add their queries to the registry


def test_pages_of_an_urgent_order_numbered_zero(spark, tmp_path):
    """Before: page 0 stood for another page, so the urgent order 0 was taken as on its own page."""
    con = duckdb.connect()
    tables = {
        "orders": "SELECT range AS o_orderkey, CASE WHEN range % 3 = 2 THEN 'P' ELSE 'O' END AS o_orderstatus, CASE WHEN range % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM range(8)",
        "lineitem": "SELECT range // 4 AS l_orderkey, range % 9 AS l_partkey, range % 5 AS l_suppkey, CAST(range % 7 AS INT) AS l_linenumber, 1.0::DOUBLE AS l_quantity, range * 1.0::DOUBLE AS l_extendedprice, (range % 4) / 100::DOUBLE AS l_discount, (range % 5) / 100::DOUBLE AS l_tax, ['N', 'A', 'R'][1 + range % 3] AS l_returnflag FROM range(28)",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name in ("j7_further_pages", "j7_carried", "j7_refusals"):
        out = registry.QUERIES[name](spark, str(tmp_path))
        cols = ", ".join(out.columns)
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, con.execute(f"SELECT {cols} FROM ({registry.ORACLE[name]})").fetchall())), name
