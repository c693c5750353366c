"""Registered queries against their SQL on made tables, where sf0.001 has no such rows."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__


def both(spark, folder, name, **tables):
    """A query's rows on the given tables, and its SQL's."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder)).collect()
    return sorted(map(tuple, got)), sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_canonical_hash_selects_by_the_scores_of_its_statement(spark, tmp_path):
    when = datetime.datetime(2024, 1, 1)
    prices = [0.0, 1e5 - 0.0002, 1e5, *(10.0 * k for k in range(1, 8))]  # the best two are one number as floats
    keys = [k + k // 4 + 1 for k in range(len(prices))]  # none is a multiple of 5
    orders = pa.table({"o_orderkey": keys, "o_custkey": [1] * len(keys), "o_totalprice": prices, "o_orderdate": [when] * len(keys), "o_orderpriority": ["1-URGENT"] * len(keys)})
    customer, nation = pa.table({"c_custkey": [1], "c_nationkey": [0]}), pa.table({"n_nationkey": [0], "n_name": ["a"]})
    lineitem = pa.table({"l_orderkey": pa.array([], pa.int64()), "l_quantity": pa.array([], pa.float64()), "l_discount": pa.array([], pa.float64())})
    got, want = both(spark, tmp_path, "canonical_hash", orders=orders, customer=customer, nation=nation, lineitem=lineitem)
    assert got == want and [r[:2] for r in got] == [(0, 1)]


def test_percent_text_rounds_the_doubles_themselves(spark, tmp_path):
    shares = [(h, n) for n in (7, 16, 32, 40, 80, 160, 200, 800, 2000) for h in range(1, min(n, 60))]  # many end in a half of the last digit
    users, kinds = [], []
    for u, (h, n) in enumerate(shares):
        users += [u] * (n + 1)
        kinds += ["purchase"] * h + ["click"] * (n - h) + ["error"]
    events = pa.table({"user_id": [*users, 9999], "event_type": [*kinds, "error"]})
    got, want = both(spark, tmp_path, "percent_text", events=events)
    assert got == want and dict(got)[9999] == "n/a" and dict(got)[shares.index((1, 32))] == "3.12%"
