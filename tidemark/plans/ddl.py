"""Schema changes: found as differences of the catalog, rendered as SQL, and applied to tables of data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spark_type


def quote(name: str) -> str:
    """An identifier, quoted where it isn't plain lower case."""
    return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name) else '"' + name.replace('"', '""') + '"'


def quoted(name: Any) -> Any:
    """The same of a column of identifiers."""
    return F.when(name.rlike("^[a-z_][a-z0-9_]*$"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def qualified(schema: str, name: str) -> str:
    return f"{quote(schema)}.{quote(name)}"


@dataclass
class Column:
    name: str
    type: str
    not_null: bool = False
    default: str | None = None

    def sql(self) -> str:
        return f"{quote(self.name)} {self.type}" + (f" DEFAULT {self.default}" if self.default is not None else "") + (" NOT NULL" if self.not_null else "")


@dataclass
class Statement:
    """One schema change: what kind, of what, and the details that its kind needs."""

    kind: str
    schema: str = ""
    name: str = ""
    details: dict[str, Any] = field(default_factory=dict)

    def sql(self) -> str:
        return RENDER[self.kind](self)


def _create_table(s: Statement) -> str:
    d = s.details
    kind = "TEMP " if d.get("temporary") else "UNLOGGED " if d.get("unlogged") else ""
    head = f"CREATE {kind}TABLE {qualified(s.schema, s.name)}"
    if d.get("partition_of"):
        bound = d["bound"]
        if "modulus" in bound:
            values = f"FOR VALUES WITH (MODULUS {bound['modulus']}, REMAINDER {bound['remainder']})"
        elif "in" in bound:
            values = f"FOR VALUES IN ({', '.join(bound['in'])})"
        elif "from" in bound:
            values = f"FOR VALUES FROM ({', '.join(bound['from'])}) TO ({', '.join(bound['to'])})"
        else:
            values = "DEFAULT"
        return f"{head} PARTITION OF {d['partition_of']} {values}"
    out = f"{head} ({', '.join(c.sql() for c in d['columns'])})"
    if d.get("inherits"):
        out += f" INHERITS ({', '.join(d['inherits'])})"
    if d.get("partition_by"):
        method, keys = d["partition_by"]
        out += f" PARTITION BY {method.upper()} ({', '.join(map(quote, keys))})"
    return out


def _create_index(s: Statement) -> str:
    d = s.details
    parts = [p if p.startswith("(") else quote(p) for p in d["columns"]]
    return f"CREATE {'UNIQUE ' if d.get('unique') else ''}INDEX {quote(s.name)} ON {qualified(s.schema, d['table'])} USING {d.get('method', 'btree')} ({', '.join(parts)})"


def _create_sequence(s: Statement) -> str:
    d = s.details
    options = [("AS", "type"), ("INCREMENT BY", "increment"), ("MINVALUE", "min"), ("MAXVALUE", "max"), ("START WITH", "start"), ("CACHE", "cache")]
    out = f"CREATE SEQUENCE {qualified(s.schema, s.name)}" + "".join(f" {word} {d[key]}" for word, key in options if key in d)
    return out + (" CYCLE" if d.get("cycle") else "")


def _create_type(s: Statement) -> str:
    d, name = s.details, qualified(s.schema, s.name)
    if d["form"] == "enum":
        return f"CREATE TYPE {name} AS ENUM ({', '.join(_literal(x) for x in d['labels'])})"
    if d["form"] == "composite":
        return f"CREATE TYPE {name} AS ({', '.join(f'{quote(c.name)} {c.type}' for c in d['columns'])})"
    if d["form"] == "range":
        return f"CREATE TYPE {name} AS RANGE (SUBTYPE = {d['subtype']})"
    if d["form"] == "domain":
        check = f" CHECK ({d['check']})" if d.get("check") else ""
        return f"CREATE DOMAIN {name} AS {d['base']}" + (" NOT NULL" if d.get("not_null") else "") + check
    return f"CREATE TYPE {name}"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _constraint(s: Statement) -> str:
    d = s.details
    columns = ", ".join(map(quote, d.get("columns", [])))
    body = {
        "primary": f"PRIMARY KEY ({columns})",
        "unique": f"UNIQUE ({columns})",
        "check": f"CHECK ({d.get('expression')})",
        "foreign": f"FOREIGN KEY ({columns}) REFERENCES {d.get('references')} ({', '.join(map(quote, d.get('referenced', [])))})",
    }[d["form"]]
    return _alter(s) + f"ADD CONSTRAINT {quote(d['constraint'])} {body}"


def _alter(s: Statement) -> str:
    return f"ALTER TABLE {qualified(s.schema, s.name)} "


RENDER = {
    "create_table": _create_table,
    "create_schema": lambda s: f"CREATE SCHEMA {quote(s.name)}" + (f" AUTHORIZATION {quote(s.details['owner'])}" if "owner" in s.details else ""),
    "create_index": _create_index,
    "create_sequence": _create_sequence,
    "create_type": _create_type,
    "create_view": lambda s: f"CREATE VIEW {qualified(s.schema, s.name)} AS {s.details['query']}",
    "create_database": lambda s: f"CREATE DATABASE {quote(s.name)}",
    "drop_database": lambda s: f"DROP DATABASE {quote(s.name)}",
    "drop_schema": lambda s: f"DROP SCHEMA {quote(s.name)}",
    "drop_table": lambda s: f"DROP TABLE {qualified(s.schema, s.name)}",
    "drop_index": lambda s: f"DROP INDEX {qualified(s.schema, s.name)}",
    "drop_sequence": lambda s: f"DROP SEQUENCE {qualified(s.schema, s.name)}",
    "drop_type": lambda s: f"DROP TYPE {qualified(s.schema, s.name)}",
    "drop_view": lambda s: f"DROP VIEW {qualified(s.schema, s.name)}",
    "rename_column": lambda s: _alter(s) + f"RENAME COLUMN {quote(s.details['column'])} TO {quote(s.details['to'])}",
    "set_not_null": lambda s: _alter(s) + f"ALTER COLUMN {quote(s.details['column'])} SET NOT NULL",
    "drop_not_null": lambda s: _alter(s) + f"ALTER COLUMN {quote(s.details['column'])} DROP NOT NULL",
    "alter_type": lambda s: _alter(s) + f"ALTER COLUMN {quote(s.details['column'])} TYPE {s.details['type']}",
    "set_default": lambda s: _alter(s) + f"ALTER COLUMN {quote(s.details['column'])} SET DEFAULT {s.details['default']}",
    "drop_default": lambda s: _alter(s) + f"ALTER COLUMN {quote(s.details['column'])} DROP DEFAULT",
    "add_column": lambda s: _alter(s) + f"ADD COLUMN {s.details['column'].sql()}",
    "drop_column": lambda s: _alter(s) + f"DROP COLUMN {quote(s.details['column'])}",
    "rename_table": lambda s: _alter(s) + f"RENAME TO {quote(s.details['to'])}",
    "set_schema": lambda s: _alter(s) + f"SET SCHEMA {quote(s.details['to'])}",
    "set_logged": lambda s: _alter(s) + "SET LOGGED",
    "set_unlogged": lambda s: _alter(s) + "SET UNLOGGED",
    "add_constraint": _constraint,
    "drop_constraint": lambda s: _alter(s) + f"DROP CONSTRAINT {quote(s.details['constraint'])}",
    "owner": lambda s: _alter(s) + f"OWNER TO {quote(s.details['owner'])}",
    "replica_identity": lambda s: _alter(s) + f"REPLICA IDENTITY {s.details['identity']}",
    "attach_partition": lambda s: _alter(s) + f"ATTACH PARTITION {s.details['partition']} {s.details['values']}",
    "detach_partition": lambda s: _alter(s) + f"DETACH PARTITION {s.details['partition']}",
    "truncate": lambda s: f"TRUNCATE TABLE {qualified(s.schema, s.name)}",
    "reindex": lambda s: f"REINDEX INDEX {qualified(s.schema, s.name)}",
    "advance_sequence": lambda s: f"ALTER SEQUENCE {qualified(s.schema, s.name)} RESTART WITH {s.details['value']}",
}


def render_expression(nodes: list[tuple[str, str]]) -> str:
    """SQL of a default or check expression from its nodes in order: var, const, func, op, char, type, sep, bool."""
    out: list[str] = []
    for kind, text in nodes:
        if kind == "char":
            out.append(_literal(text))
        elif kind == "type":
            out.append(f"::{text}")
        elif kind == "op":
            out.append(f" {text} ")
        elif kind == "bool":
            out.append(f" {text.upper()} ")
        elif kind == "sep":
            out.append(", " if text == "," else text)
        elif kind == "var":
            out.append(quote(text))
        else:
            out.append(text)
    return "".join(out).strip()


def column_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``relid, attnum, change, sql`` of the differences of two column catalogs.

    Catalogs: relid, schema, table, attnum, name, type, not_null, default_value. A column is its number, so a
    new name is a rename. Only catalog rows are joined; tables that are new or gone as a whole aren't reported.
    """
    cols = ["name", "type", "not_null", "default_value"]
    o = old.select("relid", "attnum", F.struct(*cols).alias("o"))
    n = new.select("relid", "attnum", F.struct(*cols).alias("n"))
    t = old.select("relid", "schema", "table").distinct().join(new.select("relid").distinct(), "relid", "left_semi")
    j = o.join(n, ["relid", "attnum"], "full_outer").join(t, "relid")
    head = F.concat(F.lit("ALTER TABLE "), quoted(F.col("schema")), F.lit("."), quoted(F.col("table")), F.lit(" "))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()

    def of(change: str, when, *text) -> object:
        return F.when(when, F.struct(F.lit(change).alias("change"), F.concat(head, *[F.lit(x) if isinstance(x, str) else x for x in text]).alias("sql")))

    name, old_name = quoted(F.col("n.name")), quoted(F.col("o.name"))
    rendered = F.concat(name, F.lit(" "), F.col("n.type"), F.coalesce(F.concat(F.lit(" DEFAULT "), F.col("n.default_value")), F.lit("")), F.when(F.col("n.not_null"), " NOT NULL").otherwise(""))
    od, nd = F.col("o.default_value"), F.col("n.default_value")
    changes = [
        of("add_column", F.col("o").isNull(), "ADD COLUMN ", rendered),
        of("drop_column", F.col("n").isNull(), "DROP COLUMN ", old_name),
        of("rename_column", both & (F.col("o.name") != F.col("n.name")), "RENAME COLUMN ", old_name, " TO ", name),
        of("alter_type", both & (F.col("o.type") != F.col("n.type")), "ALTER COLUMN ", name, " TYPE ", F.col("n.type")),
        of("set_not_null", both & ~F.col("o.not_null") & F.col("n.not_null"), "ALTER COLUMN ", name, " SET NOT NULL"),
        of("drop_not_null", both & F.col("o.not_null") & ~F.col("n.not_null"), "ALTER COLUMN ", name, " DROP NOT NULL"),
        of("set_default", both & nd.isNotNull() & ~od.eqNullSafe(nd), "ALTER COLUMN ", name, " SET DEFAULT ", nd),
        of("drop_default", both & od.isNotNull() & nd.isNull(), "ALTER COLUMN ", name, " DROP DEFAULT"),
    ]
    return j.select("relid", "attnum", F.inline(F.array_compact(F.array(*changes))))


def table_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``relid, change, sql`` of the differences of two table catalogs (relid, schema, table, persistence, filenode)."""
    cols = ["schema", "table", "persistence", "filenode"]
    j = old.select("relid", F.struct(*cols).alias("o")).join(new.select("relid", F.struct(*cols).alias("n")), "relid", "full_outer")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    o_name = F.concat(quoted(F.col("o.schema")), F.lit("."), quoted(F.col("o.table")))
    n_name = F.concat(quoted(F.col("n.schema")), F.lit("."), quoted(F.col("n.table")))

    def of(change: str, when, *text) -> object:
        return F.when(when, F.struct(F.lit(change).alias("change"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text]).alias("sql")))

    same = (F.col("o.persistence") == F.col("n.persistence")) & (F.col("o.table") == F.col("n.table")) & (F.col("o.schema") == F.col("n.schema"))
    changes = [
        of("create_table", F.col("o").isNull(), "CREATE TABLE ", n_name),
        of("drop_table", F.col("n").isNull(), "DROP TABLE ", o_name),
        of("rename_table", both & (F.col("o.table") != F.col("n.table")), "ALTER TABLE ", o_name, " RENAME TO ", quoted(F.col("n.table"))),
        of("set_schema", both & (F.col("o.schema") != F.col("n.schema")), "ALTER TABLE ", o_name, " SET SCHEMA ", quoted(F.col("n.schema"))),
        of("set_logged", both & (F.col("o.persistence") == "u") & (F.col("n.persistence") == "p"), "ALTER TABLE ", o_name, " SET LOGGED"),
        of("set_unlogged", both & (F.col("o.persistence") == "p") & (F.col("n.persistence") == "u"), "ALTER TABLE ", o_name, " SET UNLOGGED"),
        of("truncate", both & same & (F.col("o.filenode") != F.col("n.filenode")), "TRUNCATE TABLE ", n_name),
    ]
    return j.select("relid", F.inline(F.array_compact(F.array(*changes))))


def evolve(rows: DataFrame, statement: Statement) -> DataFrame:
    """A table's rows after a schema change; changes that don't touch rows leave them."""
    d = statement.details
    if statement.kind == "add_column":
        c: Column = d["column"]
        value = F.expr(c.default) if c.default is not None else F.lit(None)
        return rows.withColumn(c.name, value.cast(spark_type(c.type)))
    if statement.kind == "drop_column":
        return rows.drop(d["column"])
    if statement.kind == "rename_column":
        return rows.withColumnRenamed(d["column"], d["to"])
    if statement.kind == "alter_type":
        return rows.withColumn(d["column"], F.col(d["column"]).cast(spark_type(d["type"])))
    if statement.kind == "truncate":
        return rows.limit(0)
    return rows


#: Statements that the first row of a class makes, by its kind, and the details that it has.
_CREATES = {
    "i": ("create_index", ("table", "columns", "unique", "method")),
    "S": ("create_sequence", ("type", "increment", "min", "max", "start", "cache", "cycle")),
    "v": ("create_view", ("query",)),
}


def statements_of(catalog_rows: DataFrame) -> DataFrame:
    """``xid, no, kind, sql`` of the statements that each transaction's catalog rows (xid, lsn, catalog, op, row as JSON) make.

    Transactions are dealt over all tasks, and each one's rows are folded in order as they flow through its task in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold = None, None

        def made(xid: int | None, fold: Assembler) -> list[tuple]:
            return [(xid, no, s.kind, s.sql()) for no, s in enumerate(fold.finish())]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(made_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made_schema, strict=True)], schema=made_schema)

        for batch in batches:
            out = []
            for xid, catalog, op, row in zip(*[batch.column(c).to_pylist() for c in ("xid", "catalog", "op", "row")], strict=True):
                if fold is None or xid != at:
                    if fold is not None:
                        out += made(at, fold)
                    at, fold = xid, Assembler()
                fold.feed(catalog, op, json.loads(row))
            yield batch_of(out)
        if fold is not None:
            yield batch_of(made(at, fold))

    made_schema = pa.schema([("xid", pa.int64()), ("no", pa.int64()), ("kind", pa.string()), ("sql", pa.string())])
    rows = catalog_rows.select(F.col("xid").cast("long").alias("xid"), "lsn", "catalog", "op", "row")
    return rows.repartition("xid").sortWithinPartitions("xid", "lsn").mapInArrow(run, "xid long, no long, kind string, sql string")


class Assembler:
    """Catalog row changes of one transaction, folded into statements: the first row opens one, the next complete it."""

    def __init__(self) -> None:
        self.open: dict[int, Statement] = {}
        self.shells: dict[tuple[str, str], Statement] = {}
        self.out: list[Statement] = []

    def feed(self, catalog: str, op: str, row: dict[str, Any]) -> None:
        relid = row.get("relid", 0)
        if catalog == "class" and op == "I" and row.get("relkind", "r") in ("r", "p"):
            self.open[relid] = Statement("create_table", row["schema"], row["name"], {"columns": [], **{k: v for k, v in row.items() if k in ("temporary", "unlogged", "partition_by", "partition_of", "bound", "inherits")}})
            self.out.append(self.open[relid])
        elif catalog == "class" and op == "I" and row["relkind"] in _CREATES:
            kind, keys = _CREATES[row["relkind"]]
            self.out.append(Statement(kind, row["schema"], row["name"], {k: row[k] for k in keys if k in row}))
        elif catalog == "class" and op == "U" and row.get("relkind") == "i" and row.get("filenode") != row.get("old_filenode"):
            self.out.append(Statement("reindex", row["schema"], row["name"]))
        elif catalog == "type" and op in ("I", "D"):
            key, details = (row["schema"], row["name"]), {k: v for k, v in row.items() if k not in ("schema", "name")}
            if op == "I" and key in self.shells:  # the type that was only named is given its form
                self.shells.pop(key).details = details
            else:
                self.out.append(Statement("create_type" if op == "I" else "drop_type", *key, details))
                if op == "I" and row["form"] == "shell":
                    self.shells[key] = self.out[-1]
        elif catalog == "enum" and op == "I":
            made = [s for s in self.out if s.kind == "create_type" and (s.schema, s.name) == (row["schema"], row["name"])]
            made[-1].details.setdefault("labels", []).append(row["label"])
        elif catalog == "database" and op in ("I", "D"):
            self.out.append(Statement("create_database" if op == "I" else "drop_database", name=row["name"]))
        elif catalog == "class" and op == "D":
            self.out.append(Statement({"i": "drop_index", "S": "drop_sequence", "v": "drop_view"}.get(row.get("relkind", "r"), "drop_table"), row["schema"], row["name"]))
        elif catalog == "attribute" and op == "I":
            column = Column(row["name"], row["type"], row.get("not_null", False), row.get("default"))
            if relid in self.open:
                self.open[relid].details["columns"].append(column)
            else:
                self.out.append(Statement("add_column", row["schema"], row["table"], {"column": column}))
        elif catalog == "attribute" and op == "U" and row.get("dropped"):
            self.out.append(Statement("drop_column", row["schema"], row["table"], {"column": row["name"]}))
        elif catalog == "constraint" and op in ("I", "D"):
            kind = "add_constraint" if op == "I" else "drop_constraint"
            self.out.append(Statement(kind, row["schema"], row["table"], {k: v for k, v in row.items() if k not in ("schema", "table", "relid")}))
        elif catalog == "namespace":
            self.out.append(Statement("create_schema" if op == "I" else "drop_schema", name=row["name"]))

    def finish(self) -> list[Statement]:
        return self.out
