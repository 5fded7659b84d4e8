import os
import sqlite3
from functools import partial

import pytest

from tidemark.operators import dictionary
from tidemark.operators.compact import compact
from tidemark.plans.logs import orders_log
from tidemark.plans.statements import apply_statements
from tidemark.sources.config import ConfigError, parse_config
from tidemark.sources.trail import Folder, Staging, TargetTable, read_dictionary, read_table_list, shard_queue, write_dictionary
from tidemark.streaming import apply_batch, apply_with_big

DATA = "/root/testdata/sf0.001"


def test_configuration():
    text = """
    # a comment
    jobname = capture   # another
    url = "port=5432 dbname=\\"x\\" user=postgres"
    data = '/a b/it''s'
    capture_buffer = 8192
    table = "public.test"
    table = audit.*
    unknown = some words here
    log_dir =
    """
    got = parse_config(text, "capture")
    assert got["jobname"] == "capture" and got["url"] == 'port=5432 dbname="x" user=postgres' and got["data"] == "/a b/it's"
    assert got["capture_buffer"] == 8192 and got["table"] == ["public.test", "audit.*"] and got["tableexclude"] == []
    assert got["unknown"] == "some words here" and got["trail_max_size"] == 128 and got["log_dir"] == "" and "integrate_buffer" not in got
    for bad in ("capture_buffer = 0", "capture_buffer = 32769", "ddl = yes", "no value", "a = 'open"):
        with pytest.raises(ConfigError):
            parse_config(bad, "capture")


def test_lists_shards_and_dictionaries(spark, tmp_path):
    (tmp_path / "list").write_text("# tables\n public.a \n\naudit.b # why\npublic.a\n")
    assert sorted(map(tuple, read_table_list(spark, str(tmp_path / "list")).collect())) == [("audit", "b"), ("public", "a")]
    (tmp_path / "bad").write_text("nothing\n")
    with pytest.raises(Exception, match="not schema.table"):
        read_table_list(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "shards").mkdir()
    for n in ("public_t_2_0", "public_t_2_1", "_SUCCESS"):
        (tmp_path / "shards" / n).write_text("")
    done = spark.createDataFrame([("public", "t", 0)], "schema string, table string, number int")
    assert [r["name"] for r in shard_queue(spark, str(tmp_path / "shards"), done).collect()] == ["public_t_2_1"]
    write_dictionary({"class": spark.createDataFrame([(1, "t")], "oid long, name string"), "type": spark.createDataFrame([(23, "int4")], "oid long, name string")}, str(tmp_path / "d"))
    got = read_dictionary(spark, str(tmp_path / "d"))
    assert {k: [tuple(r) for r in v.collect()] for k, v in got.items()} == {"class": [(1, "t")], "type": [(23, "int4")]}


def test_timeline_history(spark, tmp_path):
    (tmp_path / "h").write_text("1\t0/1000\tfirst\n\n2\t1/0\tsecond\n")
    got = sorted(map(tuple, dictionary.parse_history(spark, str(tmp_path / "h")).collect()))
    assert got == [(1, 0, 0x1000), (2, 0x1000, 1 << 32), (3, 1 << 32, None)]


def test_lookups_in_ranges_equal_plain_ones(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id % 3 AS k", "id AS at", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 100) AS ts")
    values = rows.where("at % 7 = 0").selectExpr("k", "at AS since", "ts AS since_ts", "at AS value")
    for left, right in (("at", "since"), ("ts", "since_ts")):
        plain = sorted(map(tuple, dictionary.as_of(rows, values, ["k"], left, right, ["value"]).collect()))
        monkeypatch.setattr(dictionary, "RANGE_ROWS", 10)
        assert sorted(map(tuple, dictionary.as_of(rows, values, ["k"], left, right, ["value"]).collect())) == plain
        monkeypatch.undo()


IMAGE = "struct<k:bigint,v:string>"
LOG = f"lsn long, commit_lsn long, xid long, op string, schema string, table string, before {IMAGE}, after {IMAGE}"


def test_a_crash_before_the_pointer_moves_loses_nothing(spark, tmp_path, monkeypatch):
    target = TargetTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    target.write(spark.createDataFrame([(i, "old") for i in range(20)], "k long, v string"), 3, 30, 1)
    batch = spark.createDataFrame([(50, 50, 5, "U", "public", "t", (7, "old"), (7, "new"))], LOG)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Folder, "write_text", crash)
        with pytest.raises(OSError):
            apply_batch(target, batch, 4)
    assert target.state()["lsn"] == 30 and target.read().where("v = 'new'").count() == 0 and target.read().count() == 20
    before = {p for _, p in target.state()["places"].items()}
    assert apply_batch(target, batch, 4) and target.read().where("v = 'new'").count() == 1 and target.read().count() == 20
    state = target.state()
    # one bucket was rewritten, the others are where they were
    assert sum(p not in before for p in state["places"].values()) == 1 and state["lsn"] == 50
    for _ in range(3):
        target.truncate()
    assert target.read().count() == 0 and len([n for n in os.listdir(tmp_path / "t") if n.startswith("CURRENT")]) == 2


def test_a_replaced_file_is_never_missing(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    folder.write_text("x", "one")
    folder.write_text("x", "two")
    assert folder.read_text("x") == "two" and folder.names() == ["x"]


def test_changes_of_other_tables_are_left_alone(spark, tmp_path):
    rows = [(1, 10, 1, "I", "public", "t", None, (2, "new")), (2, 11, 2, "T", "public", "other", None, None), (3, 12, 3, "I", "public", "other", None, (9, "no"))]
    batch = spark.createDataFrame(rows, LOG)
    target = TargetTable(spark, str(tmp_path / "t"), ["k"], source="public.t")
    target.write(spark.createDataFrame([(1, "old")], "k long, v string"))
    assert apply_batch(target, batch, 0)
    assert sorted(map(tuple, target.read().collect())) == [(1, "old"), (2, "new")]
    nameless = TargetTable(spark, str(tmp_path / "n"), ["k"])
    nameless.write(spark.createDataFrame([(1, "old")], "k long, v string"))
    with pytest.raises(ValueError):
        apply_batch(nameless, batch, 0)


def test_a_truncate_counts_by_the_order_of_commits(spark, tmp_path):
    # the row was logged after the truncate but committed before it
    rows = [(1, 20, 1, "T", "public", "t", None, None), (2, 10, 2, "I", "public", "t", None, (5, "gone")), (3, 30, 3, "I", "public", "t", None, (6, "new"))]
    target = TargetTable(spark, str(tmp_path / "t"), ["k"])
    target.write(spark.createDataFrame([(1, "old")], "k long, v string"))
    assert apply_batch(target, spark.createDataFrame(rows, LOG), 0)
    assert [tuple(r) for r in target.read().collect()] == [(6, "new")]


def test_big_transactions_wait_for_their_end(spark, tmp_path):
    staged = Staging(spark, str(tmp_path / "s"))
    big = [(1, None, 5, "I", "public", "t", None, (1, "big")), (2, None, 5, "I", "public", "t", None, (2, "big")), (3, None, 6, "I", "public", "t", None, (3, "never"))]
    for _ in range(2):  # a batch that is staged twice counts once
        staged.stage(spark.createDataFrame(big, LOG), 0)
    assert staged.waiting() == ["5", "6"] and staged.read(5).count() == 2
    target = TargetTable(spark, str(tmp_path / "t"), ["k"])
    target.write(spark.createDataFrame([], "k long, v string"))
    rows = [(4, 10, 1, "I", "public", "t", None, (1, "before")), (5, 20, 5, "XE", "public", "t", None, None), (6, 30, 2, "U", "public", "t", (2, "big"), (2, "after")), (7, 40, 6, "ABANDON", "public", "t", None, None)]
    batch = spark.createDataFrame(rows, LOG)
    assert apply_with_big(target, batch, staged, 1) == 1
    assert sorted(map(tuple, target.read().collect())) == [(1, "big"), (2, "after")] and staged.waiting() == []
    assert apply_with_big(target, batch, staged, 1) == 0 and target.state()["batch"] == 1


def test_statements_and_progress_move_together(spark, tmp_path):
    path = str(tmp_path / "db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE orders (k INTEGER PRIMARY KEY, status TEXT, price REAL, priority TEXT)")
        c.execute("CREATE TABLE sync_status (name TEXT PRIMARY KEY, lsn INTEGER)")
        c.executemany("INSERT INTO orders VALUES (?, ?, ?, ?)", [tuple(r) for r in _base(spark)])
    net = compact(orders_log(spark, DATA), ["k"])
    for _ in range(2):  # the second time everything was applied before
        apply_statements(net, partial(sqlite3.connect, path, timeout=60, isolation_level="IMMEDIATE"), None, "orders", ["k"], "job", 10_000)
    from tidemark.plans.queries import QUERIES

    with sqlite3.connect(path) as c:
        got = sorted(c.execute("SELECT * FROM orders"))
        assert {r[0] for r in c.execute("SELECT lsn FROM sync_status")} == {10_000}
    assert got == sorted(map(tuple, QUERIES["final_state_orders"](spark, DATA).collect()))


def _base(spark):
    from tidemark.plans.logs import orders_base

    return orders_base(spark, DATA).collect()
