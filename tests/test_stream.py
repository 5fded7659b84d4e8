from tidemark.plans.logs import orders_base, orders_log
from tidemark.plans.queries import QUERIES
from tidemark.sources.trail import TargetTable, catalog_snapshot, read_with_archive, stream_trail, write_trail
from tidemark.streaming import apply_batch, assemble_stream, start_apply

DATA = "/root/testdata/sf0.001"


def test_restart_in_the_middle_applies_everything_once(spark, tmp_path):
    log = orders_log(spark, DATA)
    image = log.schema["after"].dataType
    target = TargetTable(spark, str(tmp_path / "t"), ["k"])
    target.write(orders_base(spark, DATA))
    write_trail(log.where("commit_lsn <= 3000"), str(tmp_path / "log"), 2)
    for _ in range(2):  # the second run finds nothing new
        start_apply(stream_trail(spark, str(tmp_path / "log"), image), target, str(tmp_path / "c")).awaitTermination()
    version = target.state()["version"]
    write_trail(log.where("commit_lsn > 3000"), str(tmp_path / "log"), 2)
    start_apply(stream_trail(spark, str(tmp_path / "log"), image), target, str(tmp_path / "c")).awaitTermination()
    assert target.state()["version"] == version + 1
    want = {tuple(r) for r in QUERIES["final_state_orders"](spark, DATA).collect()}
    assert {tuple(r) for r in target.read().collect()} == want
    assert not apply_batch(target, log)  # a replay changes nothing


def test_truncate_in_a_batch(spark, tmp_path):
    image = "struct<k:bigint,v:string>"
    target = TargetTable(spark, str(tmp_path / "t"), ["k"])
    target.write(spark.createDataFrame([(1, "old")], "k long, v string"))
    rows = [(1, 10, 5, "I", "t", None, (2, "gone")), (2, 10, 5, "T", "t", None, None), (3, 10, 5, "I", "t", None, (3, "new"))]
    batch = spark.createDataFrame(rows, f"lsn long, commit_lsn long, xid long, op string, table string, before {image}, after {image}")
    assert apply_batch(target, batch, 0) and not apply_batch(target, batch, 0)
    assert [tuple(r) for r in target.read().collect()] == [(3, "new")]


def test_open_transactions_wait_and_aborted_ones_go(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, 1, "I"), (2, 1, "U"), (3, 2, "I"), (4, 1, "C"), (5, 2, "A"), (6, 3, "I")]
    spark.createDataFrame(rows, "lsn long, xid long, op string").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("lsn long, xid long, op string").parquet(folder)
    q = assemble_stream(stream).writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("assembled").collect()] == [(1, 2, 1, 4, "IU")]


def test_archive_fills_what_the_primary_lost(spark, tmp_path):
    import os

    log = orders_log(spark, DATA)
    image = log.schema["after"].dataType
    write_trail(log, str(tmp_path / "archive"), 3)
    files = sorted(f for f in os.listdir(tmp_path / "archive") if f.startswith("part-"))
    (tmp_path / "primary").mkdir()
    (tmp_path / "archive" / files[2]).rename(tmp_path / "primary" / files[2])
    assert read_with_archive(spark, str(tmp_path / "primary"), str(tmp_path / "archive"), image).count() == log.count()


def test_catalog_snapshot(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS snap")
    spark.sql("CREATE TABLE IF NOT EXISTS snap.t (a INT, b STRING) USING parquet")
    try:
        rows = catalog_snapshot(spark, "snap").collect()
        assert [(r["table"], r["attnum"], r["name"], r["type"]) for r in rows] == [("t", 1, "a", "int"), ("t", 2, "b", "string")]
    finally:
        spark.sql("DROP DATABASE snap CASCADE")


def test_a_big_commit_is_sorted_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.sources.trail import read_trail

    image = "struct<k:bigint,v:string>"
    rows = spark.range(4000).selectExpr("7L AS lsn", "7L AS commit_lsn", "1L AS xid", "'I' AS op", "'t' AS table", f"CAST(null AS {image}) AS before", "struct(id AS k, 'x' AS v) AS after")
    write_trail(rows, str(tmp_path / "log"), 4, whole=False)
    sizes = [r["count"] for r in read_trail(spark, str(tmp_path / "log"), rows.schema["after"].dataType).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 4000 and max(sizes) < 2000
    target = TargetTable(spark, str(tmp_path / "t"), ["k"])
    target.write(spark.createDataFrame([], "k long, v string"))
    start_apply(stream_trail(spark, str(tmp_path / "log"), rows.schema["after"].dataType, 4), target, str(tmp_path / "c")).awaitTermination()
    assert target.read().count() == 4000
