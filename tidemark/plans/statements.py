"""SQL statements that apply changes: prepared with parameters, or with literals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quote_literal
from .ddl import qualified, quote


@dataclass
class Prepared:
    """Texts of prepared statements, one for each operation, table and column list, named ``query_<n>``."""

    texts: dict[str, str] = field(default_factory=dict)

    def name(self, text: str) -> str:
        return self.texts.setdefault(text, f"query_{len(self.texts)}")

    def insert(self, schema: str, table: str, columns: list[str]) -> str:
        marks = ", ".join(f"${i}" for i in range(1, len(columns) + 1))
        return self.name(f"INSERT INTO {qualified(schema, table)} ({', '.join(map(quote, columns))}) VALUES ({marks})")

    def upsert(self, schema: str, table: str, columns: list[str], keys: list[str]) -> str:
        marks = ", ".join(f"${i}" for i in range(1, len(columns) + 1))
        rest = [c for c in columns if c not in keys]
        action = f"DO UPDATE SET {', '.join(f'{quote(c)} = EXCLUDED.{quote(c)}' for c in rest)}" if rest else "DO NOTHING"
        return self.name(f"INSERT INTO {qualified(schema, table)} ({', '.join(map(quote, columns))}) VALUES ({marks}) ON CONFLICT ({', '.join(map(quote, keys))}) {action}")

    def update(self, schema: str, table: str, columns: list[str], keys: list[str]) -> str:
        sets = ", ".join(f"{quote(c)} = ${i}" for i, c in enumerate(columns, 1))
        where = " AND ".join(f"{quote(k)} IS NOT DISTINCT FROM ${i}" for i, k in enumerate(keys, len(columns) + 1))
        return self.name(f"UPDATE {qualified(schema, table)} SET {sets} WHERE {where}")

    def delete(self, schema: str, table: str, keys: list[str], one: bool = False) -> str:
        """``one``: of equal rows of a table without a key, a single one goes."""
        where = " AND ".join(f"{quote(k)} IS NOT DISTINCT FROM ${i}" for i, k in enumerate(keys, 1))
        name = qualified(schema, table)
        if one:
            where = f"ctid = (SELECT ctid FROM {name} WHERE {where} LIMIT 1)"
        return self.name(f"DELETE FROM {name} WHERE {where}")


def apply_statements(net: DataFrame, connect: Callable[[], Any], schema: str | None, table: str, keys: list[str], job: str, commit_lsn: int, mark: str = "?", status: str = "sync_status") -> None:
    """Net changes (keys, net, after) as statements in a database, through a driver of Python's DB-API.

    Each partition deletes and inserts its keys, which no other partition holds, and moves its row of ``status`` (name,
    lsn) in one transaction. A partition that committed this LSN before does nothing, so a task may run twice. ``connect``
    is called on the executor; ``mark`` is the driver's parameter mark. Rows flow in batches, none is collected.
    """
    columns = net.schema["after"].dataType.names
    name = qualified(schema, table) if schema else quote(table)
    where = " AND ".join(f"{quote(k)} = {mark}" for k in keys)
    delete = f"DELETE FROM {name} WHERE {where}"
    insert = f"INSERT INTO {name} ({', '.join(map(quote, columns))}) VALUES ({', '.join([mark] * len(columns))})"
    # a fixed number of parts, so that a part has the same keys when it runs again
    rows = net.select(*keys, "net", "after").repartition(int(net.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    def run(part: int, changes: Iterator[Any]) -> Iterator[int]:
        connection, who = connect(), f"{job}/{part}"
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT lsn FROM {status} WHERE name = {mark}", (who,))
            done = cursor.fetchone()
            if done and done[0] >= commit_lsn:
                return
            for batch in _batches(changes, 1000):
                cursor.executemany(delete, [tuple(r[k] for k in keys) for r in batch])
                new = [tuple(r["after"][c] for c in columns) for r in batch if r["net"] != "D"]
                if new:
                    cursor.executemany(insert, new)
            cursor.execute(f"DELETE FROM {status} WHERE name = {mark}", (who,))
            cursor.execute(f"INSERT INTO {status} (name, lsn) VALUES ({mark}, {mark})", (who, commit_lsn))
            connection.commit()
        finally:
            connection.close()
        yield part

    rows.rdd.mapPartitionsWithIndex(run).count()


def _batches(rows: Iterator[Any], size: int) -> Iterator[list[Any]]:
    while batch := list(islice(rows, size)):
        yield batch


def literal_updates(rows: DataFrame, schema: str, table: str, keys: list[str]) -> DataFrame:
    """``sql``: an UPDATE by key with literals for each row, of all columns that aren't keys."""
    sets = [F.concat(F.lit(f"{quote(c)} = "), F.coalesce(quote_literal(F.col(c).cast("string")), F.lit("NULL"))) for c in rows.columns if c not in keys]
    tests = [F.when(F.col(k).isNull(), F.lit(f"{quote(k)} IS NULL")).otherwise(F.concat(F.lit(f"{quote(k)} = "), quote_literal(F.col(k).cast("string")))) for k in keys]
    return rows.select(F.concat(F.lit(f"UPDATE {qualified(schema, table)} SET "), F.concat_ws(", ", *sets), F.lit(" WHERE "), F.concat_ws(" AND ", *tests)).alias("sql"))


def literal_inserts(rows: DataFrame, schema: str, table: str) -> DataFrame:
    """``sql``: an INSERT with literals for each row."""
    columns = rows.columns
    head = f"INSERT INTO {qualified(schema, table)} ({', '.join(map(quote, columns))}) VALUES ("
    values = [quote_literal(F.col(c).cast("string")) for c in columns]
    return rows.select(F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(")")).alias("sql"))


def literal_deletes(rows: DataFrame, schema: str, table: str, keys: list[str]) -> DataFrame:
    """``sql``: a DELETE by key with literals for each row."""
    tests = [F.when(F.col(k).isNull(), F.lit(f"{quote(k)} IS NULL")).otherwise(F.concat(F.lit(f"{quote(k)} = "), quote_literal(F.col(k).cast("string")))) for k in keys]
    return rows.select(F.concat(F.lit(f"DELETE FROM {qualified(schema, table)} WHERE "), F.concat_ws(" AND ", *tests)).alias("sql"))
