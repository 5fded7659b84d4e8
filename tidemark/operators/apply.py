"""Applying net changes to target tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(target: DataFrame, net: DataFrame, keys: list[str], upsert: bool = True) -> DataFrame:
    """``target`` after the net changes (keys, net, after): one join on the keys, both sides shuffled once.

    upsert: a net insert takes the place of a row that has its key already; if not, both are there, as in a table
    whose key isn't enforced.
    """
    columns = target.columns
    t = target.select(*[F.col(k).alias(f"__t_{k}") for k in keys], F.struct(*columns).alias("__row"))
    n = net.select(*[F.col(k).alias(f"__n_{k}") for k in keys], F.col("net").alias("__net"), F.col("after").alias("__after"))
    cond = [F.col(f"__t_{k}") == F.col(f"__n_{k}") for k in keys]
    if not upsert:
        cond.append(F.col("__net") != "I")
    joined = t.join(n, cond, "full_outer").where("__net IS NULL OR __net <> 'D'")
    return joined.select(*[F.when(F.col("__net").isNull(), F.col(f"__row.{c}")).otherwise(F.col(f"__after.{c}")).alias(c) for c in columns])


def bag_delete(target: DataFrame, deletes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``target`` without as many copies of each row as ``deletes`` holds; for tables without a key.

    Copies are counted before they are taken away: no row number is given within a group of equal rows,
    so a row that a third of the table repeats stays one counter.
    """
    columns = columns or target.columns
    have = target.groupBy(columns).agg(F.count("*").alias("__have"))
    gone = deletes.groupBy(columns).agg(F.count("*").alias("__gone"))
    cond = [F.col(f"h.{c}").eqNullSafe(F.col(f"g.{c}")) for c in columns]
    left = have.alias("h").join(gone.alias("g"), cond, "left").select("h.*", F.greatest(F.col("__have") - F.coalesce("__gone", F.lit(0)), F.lit(0)).alias("__left"))
    return _repeat(left, columns)


def _repeat(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row ``__left`` times."""
    return rows.where("__left > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("__left"))).alias("__i")).drop("__i")


def move_keys(target: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """UPDATE ... FROM: rows whose key is an old key of ``moves`` (old_<key> and the new columns) take the new columns."""
    columns = target.columns
    m = moves.select(*[F.col(f"old_{k}").alias(f"__o_{k}") for k in keys], F.struct(*columns).alias("__new"))
    joined = target.join(m, [F.col(k) == F.col(f"__o_{k}") for k in keys], "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def apply_rows(target: DataFrame, log: DataFrame, keys: list[str], order: str = "lsn") -> DataFrame:
    """Row-by-row semantics: the last change of each key decides, whatever came before it."""
    gone = log.where("op IN ('U', 'D')").select(*[F.col(f"before.{k}").alias(k) for k in keys], F.struct(F.col(order), F.lit(0)).alias("at"), F.lit(None).cast(log.schema["after"].dataType).alias("after"))
    come = log.where("op IN ('I', 'U')").select(*[F.col(f"after.{k}").alias(k) for k in keys], F.struct(F.col(order), F.lit(1)).alias("at"), "after")
    last = gone.unionByName(come).groupBy(keys).agg(F.max_by(F.struct("after"), "at").alias("x"))
    return merge(target, last.select(*keys, F.when(F.col("x.after").isNull(), "D").otherwise("U").alias("net"), F.col("x.after").alias("after")), keys)
