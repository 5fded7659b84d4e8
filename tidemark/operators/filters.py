"""Which changes pass: by table name, dataset, transaction, log position and snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_matches(name: Column, pattern: str) -> Column:
    """``*`` stands for any text; only the first one counts, a second is an ordinary character. Case matters."""
    head, star, tail = pattern.partition("*")
    if not star:
        return name == head
    if not head and not tail:
        return name.isNotNull()
    fits = F.length(name) >= len(head) + len(tail)
    return name.startswith(head) & name.endswith(tail) & fits


def rule_matches(schema: Column, table: Column, rule: str) -> Column:
    """``schema.table``, each with at most one ``*``."""
    s, _, t = rule.partition(".")
    return name_matches(schema, s) & name_matches(table, t)


def _any(schema: Column, table: Column, rules: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (rule_matches(schema, table, r) for r in rules), F.lit(False))


def table_passes(schema: Column, table: Column, include: list[str] | None, exclude: list[str] | None, relkind: Column | None = None) -> Column:
    """Ordinary and partitioned tables that no exclude rule and some include rule matches; no list means no restriction."""
    ok = F.lit(True) if relkind is None else relkind.isin("r", "p")
    if exclude:
        ok = ok & ~_any(schema, table, exclude)
    return ok & _any(schema, table, include) if include else ok


def filter_tables(changes: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    return changes.where(table_passes(F.col("schema"), F.col("table"), include, exclude))


def in_dataset(changes: DataFrame, dataset: DataFrame, key: str = "relid", local: DataFrame | None = None) -> DataFrame:
    """Changes of tables of the dataset; ``local`` (xid, key) holds tables that only their own transaction sees yet."""
    passed = changes.join(dataset.select(key).distinct(), key, "left_semi")
    if local is None:
        return passed
    rest = changes.join(dataset.select(key).distinct(), key, "left_anti").join(local.select("xid", key).distinct(), ["xid", key], "left_semi")
    return passed.unionByName(rest.select(passed.columns))


def not_in_dataset(changes: DataFrame, dataset: DataFrame, key: str = "relid") -> DataFrame:
    return changes.join(dataset.select(key).distinct(), key, "left_anti")


def added_tables(created: DataFrame, patterns: list[str]) -> DataFrame:
    """Created tables that join the dataset because a pattern matches them."""
    return created.where(_any(F.col("schema"), F.col("table"), patterns))


def without_loops(changes: DataFrame, progress_relids: list[int], catalog: Column | None = None) -> DataFrame:
    """Without the transactions that touch a progress table, which another replicator wrote; their catalog changes stay."""
    looped = changes.where(F.col("relid").isin(progress_relids)).select("xid").distinct()
    kept = changes.join(looped, "xid", "left_anti")
    if catalog is None:
        return kept
    return kept.unionByName(changes.where(catalog).join(looped, "xid", "left_semi").select(kept.columns))


def after_lsn(changes: DataFrame, confirmed: int, metadata: Column | None = None) -> DataFrame:
    """Changes of transactions that end after ``confirmed``; of earlier ones only metadata stays."""
    late = F.col("commit_lsn") > confirmed
    return changes.where(late if metadata is None else late | metadata)


def after_position(changes: DataFrame, file_id: int, offset: int, metadata: Column | None = None) -> DataFrame:
    """Records from (file, offset) on; ``metadata`` passes anyway."""
    late = (F.col("file_id") > file_id) | ((F.col("file_id") == file_id) & (F.col("offset") >= offset))
    return changes.where(late if metadata is None else late | metadata)


def from_first_begin(records: DataFrame, order: str = "lsn", op: str = "op") -> DataFrame:
    """Without records before the first transaction begin."""
    first = records.where(F.col(op) == "B").agg(F.min(order).alias("__first"))
    return records.join(F.broadcast(first), F.col(order) >= F.col("__first")).drop("__first")


def without_temporary(changes: DataFrame) -> DataFrame:
    """Without temporary and system tables."""
    s, t = F.coalesce("schema", F.lit("")), F.coalesce("table", F.lit(""))
    return changes.where(~(s.startswith("pg_temp") | t.startswith("pg_temp_") | s.isin("pg_catalog", "information_schema", "pg_toast")))


def in_database(changes: DataFrame, database: int, column: str = "dbid") -> DataFrame:
    """Records of one database, and global ones (0)."""
    return changes.where(F.col(column).isin(database, 0))


def concurrent_with_snapshot(xid: Column, xmin: int, xmax: int, in_progress: list[int], refresh_xid: int) -> Column:
    """Whether a snapshot doesn't hold a transaction's changes but its refresh has to: started at or after xmax, or running then, and before the refresh ended."""
    return ((xid >= xmax) & (xid != xmin) & (xid < refresh_xid)) | xid.isin(in_progress)


def not_refreshed(changes: DataFrame, refreshes: DataFrame) -> DataFrame:
    """Without changes that a table's refresh holds already; refreshes: relid, refresh_xid."""
    r = refreshes.groupBy("relid").agg(F.max("refresh_xid").alias("__refresh"))
    return changes.join(r, "relid", "left").where(F.col("__refresh").isNull() | (F.col("xid") >= F.col("__refresh"))).drop("__refresh")


def recent_history(history: DataFrame, snapshot_lsn: int) -> DataFrame:
    """Dictionary history from the snapshot on."""
    return history.where(F.col("lsn") >= snapshot_lsn)


def ddl_passes(statements: DataFrame, enabled: bool) -> DataFrame:
    """Nothing while DDL is off; never the internal tables that hold large values."""
    if not enabled:
        return statements.limit(0)
    return statements.where(~F.coalesce("table", F.lit("")).startswith("pg_toast"))
