import pytest
from pyspark.sql import functions as F

from tidemark.functions import spark_type, time_lag
from tidemark.plans.ddl import Assembler, Column, Statement, render_expression, statements_of
from tidemark.plans.jobs import Client, CommandError, Manager, decode_rows, encode_rows, execute, main, serve
from tidemark.plans.statements import Prepared


def test_statements_render():
    cases = {
        "CREATE TABLE public.users (id int8 NOT NULL, name text DEFAULT 'x') PARTITION BY HASH (id)": Statement("create_table", "public", "users", {"columns": [Column("id", "int8", True), Column("name", "text", default="'x'")], "partition_by": ("hash", ["id"])}),
        "CREATE TABLE public.p1 PARTITION OF public.p FOR VALUES WITH (MODULUS 4, REMAINDER 1)": Statement("create_table", "public", "p1", {"partition_of": "public.p", "bound": {"modulus": 4, "remainder": 1}}),
        "CREATE UNIQUE INDEX i ON public.t USING btree (a, (lower(b)))": Statement("create_index", "public", "i", {"table": "t", "unique": True, "columns": ["a", "(lower(b))"]}),
        "CREATE SEQUENCE public.s INCREMENT BY 2 START WITH 5 CYCLE": Statement("create_sequence", "public", "s", {"increment": 2, "start": 5, "cycle": True}),
        "CREATE TYPE public.mood AS ENUM ('it''s', 'ok')": Statement("create_type", "public", "mood", {"form": "enum", "labels": ["it's", "ok"]}),
        "CREATE DOMAIN public.d AS int4 NOT NULL CHECK (value > 0)": Statement("create_type", "public", "d", {"form": "domain", "base": "int4", "not_null": True, "check": "value > 0"}),
        'ALTER TABLE public."T" ADD CONSTRAINT pk PRIMARY KEY (id)': Statement("add_constraint", "public", "T", {"form": "primary", "constraint": "pk", "columns": ["id"]}),
        "ALTER SEQUENCE public.s RESTART WITH 9": Statement("advance_sequence", "public", "s", {"value": 9}),
        "ALTER TABLE public.t ALTER COLUMN a TYPE text": Statement("alter_type", "public", "t", {"column": "a", "type": "text"}),
        "DROP SCHEMA audit": Statement("drop_schema", name="audit"),
    }
    for sql, statement in cases.items():
        assert statement.sql() == sql


def test_expression():
    nodes = [("func", "coalesce("), ("var", "a"), ("sep", ","), ("char", "it's"), ("type", "text"), ("sep", ")"), ("op", "="), ("const", "1")]
    assert render_expression(nodes) == "coalesce(a, 'it''s'::text) = 1"


def test_catalog_rows_become_statements():
    a = Assembler()
    a.feed("class", "I", {"relid": 1, "schema": "public", "name": "t"})
    a.feed("attribute", "I", {"relid": 1, "name": "id", "type": "int4", "not_null": True})
    a.feed("attribute", "I", {"relid": 2, "schema": "public", "table": "old", "name": "c", "type": "text"})
    a.feed("class", "D", {"relid": 3, "schema": "public", "name": "i", "relkind": "i"})
    assert [s.sql() for s in a.finish()] == ["CREATE TABLE public.t (id int4 NOT NULL)", "ALTER TABLE public.old ADD COLUMN c text", "DROP INDEX public.i"]


def test_transactions_are_folded_from_batches(spark):
    names = [(x, i, "namespace", "I", f'{{"name": "s{i}"}}') for x in (None, 1, 2, 2**60 + 1) for i in range(5)]
    rows = spark.createDataFrame(names[::-1], "xid long, lsn long, catalog string, op string, row string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = statements_of(rows)
        got = {tuple(r) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(x, i, "create_schema", f"CREATE SCHEMA s{i}") for x in (None, 1, 2, 2**60 + 1) for i in range(5)}
    # no call of Python for each transaction
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_prepared_texts_are_shared():
    p = Prepared()
    assert p.insert("public", "t", ["a", "b"]) == "query_0" == p.insert("public", "t", ["a", "b"])
    assert p.upsert("public", "t", ["a", "b"], ["a"]) == "query_1"
    assert p.delete("public", "t", ["a"], one=True) == "query_2"
    assert list(p.texts)[1].endswith("ON CONFLICT (a) DO UPDATE SET b = EXCLUDED.b")


def test_types():
    assert spark_type("numeric", ((10 << 16) | 2) + 4) == "decimal(10,2)"
    assert spark_type("numeric") == "string" and spark_type("_int4") == "array<int>"


def test_time_lag_of_large_numbers(spark):
    x = 13_223_142 * 3_600_000_000 - 1  # floating point makes a whole hour of it
    rows = spark.createDataFrame([(x,), (x + 1,), (59_999_999,), (-1,)], "x long").select(time_lag(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["13223141h 59m 59s", "13223142h 0m 0s", "59s 999999us", "0s -1us"]


def test_job_life_and_errors(tmp_path, capsys):
    m = Manager(str(tmp_path))
    out = []
    for line in ("create capture C1;", "create integrate i1", "create progress p c1, i1", "init capture c1", "start capture c1", "edit capture c1 buffer=64", "list", "info capture c1"):
        execute(m, line, out.append)
    assert out[0] == "capture c1 online" and m.load("capture", "c1").options == {"buffer": "64"}
    for bad in ("start capture c1", "create capture c1", "remove capture c1", "refresh c1 orders", "fly away", "init nothing x"):
        with pytest.raises(CommandError):
            execute(m, bad)
    execute(m, "refresh c1 public.orders, public.lineitem")
    assert m.refreshes == [("c1", "public.orders"), ("c1", "public.lineitem")]
    execute(m, "alter progress p remove i1")
    assert m.load("progress", "p").members == ["c1"]
    execute(m, "watch capture c1 0", out.append, rounds=2)
    execute(m, "reload capture c1")
    execute(m, "stop capture c1")
    execute(m, "remove capture c1")
    execute(m, "drop integrate i1")
    assert [j.name for j in m.list()] == ["p"]
    assert main([str(tmp_path), "list"]) == 0 and "progress p nop" in capsys.readouterr().out
    assert main([str(tmp_path), "start", "capture", "c1"]) == 1


def test_client_reads_rows_and_errors(tmp_path):
    m = Manager(str(tmp_path))
    c = Client(lambda message: serve(m, message))
    assert c.command("create capture c1") == [] and c.error is None
    assert c.command("list") == [{"kind": "capture", "name": "c1", "state": "nop", "metrics": None}]
    assert c.command("start integrate x") is None and "no integrate x" in c.error
    assert decode_rows(encode_rows(["a", "b"], [[None, "x"], ["", None]])) == (["a", "b"], [[None, "x"], ["", None]])
