"""Every declarative query against the same operator in DuckDB."""

import duckdb
import pytest

from drovekit.plans import sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in sql.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sql.QUERIES)
def test_same_rows(spark, duck, name):
    got = sql.query(name)(spark, DATA)
    want = duck.sql(sql.oracle(name))
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


def test_chamfer_meets_all_lines_of_a_class(spark, duck):
    import numpy as np

    lines = {i: (label, np.array(e, float).reshape(-1, 2)[:32]) for i, label, e in duck.sql("SELECT vec_id, label, embedding FROM embeddings").fetchall()}
    got = {(r.pred, r.gt): r.distance for r in sql.query("chamfer")(spark, DATA).collect()}
    assert set(got) == {(p, g) for p in lines for g in lines if lines[p][0] == lines[g][0]}
    for p, g in list(got)[::50]:
        d = np.linalg.norm(lines[p][1][:, None] - lines[g][1][None], axis=2)
        assert got[p, g] == pytest.approx((d.min(0).mean() + d.min(1).mean()) / 2, abs=2e-6)


def test_required_files_of_all_orders(spark, duck):
    got = {(r.token, r.file) for r in sql.query("required_files")(spark, DATA).collect()}
    assert got == {(o, f"samples/{s}") for o, s in duck.sql("SELECT l_orderkey, l_suppkey FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey").fetchall()}
