"""Every query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from tidemark.operators.transactions import commit_order
from tidemark.plans.logs import orders_log
from tidemark.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert _sorted(tuple(r[c] for c in columns) for r in df.collect()) == _sorted(want)


def test_greedy_bundles_equal_a_fold(spark):
    rows = QUERIES["txn_bundles_greedy"](spark, DATA).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["xid"]):
        by.setdefault(r["stream"], []).append(r)
    for stream in by.values():
        used = number = None
        for r in stream:
            n = r["statements"]
            if number is None:
                number, used = 0, n
            elif n >= 50 or used + n >= 50 or used >= 50:
                number, used = number + 1, n
            else:
                used += n
            assert r["bundle"] == number


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_results_that_have_an_order_keep_it(spark):
    rows = [(r["commit_lsn"], r["lsn"]) for r in QUERIES["commit_order"](spark, DATA).collect()]
    assert rows == sorted(rows)
    log = orders_log(spark, DATA).withColumn("commit_lsn", -F.col("lsn") % 1000)
    rows = [(r["commit_lsn"], r["lsn"]) for r in commit_order(log).collect()]
    assert rows == sorted(rows) and len({c for c, _ in rows}) > 100
    batches = [(r["missing_count"], r["missing_map"]) for r in QUERIES["missing_map_batches"](spark, DATA).collect()]
    assert batches == sorted(batches)


def test_lsn_hex_takes_the_whole_log(spark, tmp_path):
    rows = [(k, "O", 1.5, "1-URGENT") for k in (5, 8, 24_999, 25_008, 149_995, 600_000)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["lsn_hex"](spark, str(tmp_path)).collect()
    log = [r["lsn"] for r in orders_log(spark, str(tmp_path)).select("lsn").collect()]
    assert max(log) > 100_000 and sorted(r["lsn"] for r in got) == sorted(log)
    for r in got:
        p = r["lsn"] * 4294967301
        assert (r["text"], r["back"]) == (f"{p >> 32:X}/{p & 0xFFFFFFFF:X}", p)


def test_a_key_that_moves_to_one_in_use_leaves_both_rows(spark, tmp_path):
    rows = [(k, "O", 1.5, "1-URGENT") for k in (13, 14, 1_000_000, 1_000_013, 1_000_026, 13_000_000)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = c.execute(ORACLE_SQL["key_change_merge"]).fetchall()
    assert len({r[0] for r in want}) < len(want)
    assert _sorted(map(tuple, QUERIES["key_change_merge"](spark, str(tmp_path)).collect())) == _sorted(want)
