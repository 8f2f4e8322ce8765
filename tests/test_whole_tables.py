"""Queries that read whole tables while their registered SQL has an older restriction: against that SQL without it."""

import duckdb
import pytest

from texloom import registry

#: Query -> (what its registered SQL restricts, the same without the restriction).
WHOLE = {
    "hamming_neighbors": [("WHERE b.vec_id < 100", "")],
    "covariance_matrix": [("range(1, 9)", "range(1, 65)")],
    **dict.fromkeys(("causal_neighbors", "previous_frame", "combine_images"), None),
}


def _all_lines(sql: str) -> str:
    """Blocks from the line of least number of each order, where the registered SQL takes only lines numbered 1."""
    least = "(SELECT l_orderkey, arg_min(l_quantity, l_linenumber * 1000 + l_quantity) AS l_quantity, 1 AS l_linenumber FROM lineitem GROUP BY 1)"
    assert "FROM lineitem" in sql and "l_linenumber = 1" in sql
    return sql.replace("FROM lineitem", f"FROM {least}")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table(spark, sf_dir, name):
    sql = registry.oracle_sql()[name]
    for old, new in WHOLE[name] or []:
        assert old in sql
        sql = sql.replace(old, new)
    if WHOLE[name] is None:
        sql = _all_lines(sql)
    con = duckdb.connect()
    for table in ("lineitem", "embeddings", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    near = lambda x: round(x, 6) if isinstance(x, float) else x
    want = sorted((tuple(near(x) for x in r) for r in found.fetchall()), key=repr)
    got = sorted((tuple(near(r[c]) for c in columns) for r in registry.queries()[name](spark, sf_dir).collect()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", ["causal_neighbors", "previous_frame", "combine_images"])
def test_lines_numbered_1_give_the_rows_of_the_registered_sql(spark, tmp_path, name):
    """Quantities that are null beside others or have fractions, where the SQL's restriction takes nothing away."""
    lines = [(65, 1, None), (65, 1, 4.0), (66, 1, 3.5), (67, 1, 4.5), (68, 1, 4.6), (129, 1, None), (130, 1, 2.4), (130, 1, 9.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = [tuple(r[c] for c in columns) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(found.fetchall(), key=repr) and got


def test_lines_without_a_number_come_last(spark, tmp_path):
    lines = [(65, None, 1.0), (65, 3, 6.0), (66, None, 7.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.queries()["causal_neighbors"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 2, 3), (2, 1, 3, 3)]
