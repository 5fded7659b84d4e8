"""Compaction: many changes of a key become one, by aggregation alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import row_hash
from ..schema import BARRIERS
from .dictionary import as_of
from .transactions import running


def decompose(log: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Updates as a delete of the old row and an insert of the new one.

    Columns: the keys, ``at`` (struct of the order and 0 for deletes, 1 for inserts), ``half`` (D or I),
    ``image``, ``update`` (from an update) and ``moved`` (its key changed). log: op, before, after.
    """
    order = order or ["lsn"]
    gone = F.struct(*order, F.lit(0).alias("half_no")).alias("at")
    come = F.struct(*order, F.lit(1).alias("half_no")).alias("at")
    update = F.col("op") == "U"
    same = [F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}")) for k in keys]
    moved = same[0]
    for s in same[1:]:
        moved = moved & s
    moved = (update & ~moved).alias("moved")
    old = F.struct(gone, F.lit("D").alias("half"), F.col("before").alias("image"), update.alias("update"), moved)
    new = F.struct(come, F.lit("I").alias("half"), F.col("after").alias("image"), update.alias("update"), moved)
    halves = F.when(update, F.array(old, new)).when(F.col("op") == "D", F.array(old)).otherwise(F.array(new))
    # one pass over the log: no union of two scans
    out = log.where(F.col("op").isin("I", "U", "D")).select(F.inline(halves))
    return out.select(*[F.col(f"image.{k}").alias(k) for k in keys], "*")


def compact(log: DataFrame, keys: list[str], order: list[str] | None = None, segment: str | None = None) -> DataFrame:
    """The net change of each key (and segment): ``net`` (I, U or D), ``before`` and ``after``.

    A key whose first half is a delete was there before, one whose last half is an insert is there
    afterwards. Inserts fold with later updates, an insert with a later delete annihilates, and so does a
    delete with a later insert of an equal row. Only the first and the last half of a key matter, so map
    sides shrink hot keys before the one shuffle.
    """
    halves = decompose(log, keys, order) if segment is None else decompose_with(log, keys, order, segment)
    by = [*keys, *([segment] if segment else [])]
    ends = halves.groupBy(by).agg(F.min_by(F.struct("half", "image"), "at").alias("first"), F.max_by(F.struct("half", "image"), "at").alias("last"), F.count("*").alias("halves"))
    was, stays = F.col("first.half") == "D", F.col("last.half") == "I"
    same = F.col("first.image").eqNullSafe(F.col("last.image"))
    net = F.when(was & stays & ~same, "U").when(was & ~stays, "D").when(~was & stays, "I")
    return ends.select(*by, net.alias("net"), F.when(was, F.col("first.image")).alias("before"), F.when(stays, F.col("last.image")).alias("after"), "halves").where("net IS NOT NULL")


def decompose_with(log: DataFrame, keys: list[str], order: list[str] | None, extra: str) -> DataFrame:
    """``decompose`` that carries one more column."""
    order = order or ["lsn"]
    wide = log.withColumns({"before": F.when(F.col("before").isNotNull(), F.struct("before.*", F.col(extra))), "after": F.when(F.col("after").isNotNull(), F.struct("after.*", F.col(extra)))})
    halves = decompose(wide, keys, order)
    names = [f.name for f in log.schema["after"].dataType.fields]
    return halves.withColumn(extra, F.col(f"image.{extra}")).withColumn("image", F.struct(*[F.col(f"image.{n}") for n in names]))


def annihilated(log: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Keys that were inserted and deleted again within the log."""
    ends = decompose(log, keys, order).groupBy(keys).agg(F.min_by("half", "at").alias("first"), F.max_by("half", "at").alias("last"))
    return ends.where("first = 'I' AND last = 'D'").select(keys)


def segments(log: DataFrame, order: str = "lsn", table: str = "table") -> DataFrame:
    """Adds ``segment``: how many barriers (DDL, truncate, markers) of the table came before.

    Only barriers are numbered; the log's rows look the latest one up, in ranges of the log.
    """
    at = log.where(F.col("op").isin(*BARRIERS)).select(F.col(table).alias("__t"), F.col(order).alias("__b")).distinct()
    numbered = running(at, ["__t"], "__b", F.lit(1), "__n").select(F.col("__t").alias(table), "__b", (F.col("__n") + 1).alias("__segment"))
    out = as_of(log, numbered, [table], order, "__b", ["__segment"])
    return out.withColumn("segment", F.coalesce("__segment", F.lit(0)).cast("long")).drop("__segment")


def after_truncate(log: DataFrame, order: str = "lsn", table: str = "table") -> DataFrame:
    """Row changes after the last truncate of their table."""
    last = log.where("op = 'T'").groupBy(table).agg(F.max(order).alias("__last"))
    # a row for each truncated table: sent to all tasks, as a shuffle by table would bring a table's log to one
    return log.where("op <> 'T'").join(F.broadcast(last), table, "left").where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).drop("__last")


def complement(newer: str, older: str, missing: str, columns: list[str]) -> list[Column]:
    """Columns of image ``newer``, from ``older`` where ``missing`` names them."""
    return [F.when(F.coalesce(F.array_contains(missing, c), F.lit(False)), F.col(f"{older}.{c}")).otherwise(F.col(f"{newer}.{c}")).alias(c) for c in columns]


def fold_missing(log: DataFrame, keys: list[str], columns: list[str], order: str = "lsn", missing: str = "missing_after") -> DataFrame:
    """The latest recorded value of each column of a key: images that miss a column don't touch it."""
    image = [F.max_by(F.struct(F.col(f"after.{c}").alias("v")), F.when(~F.coalesce(F.array_contains(missing, c), F.lit(False)), F.col(order)))["v"].alias(c) for c in columns]
    return log.where("after IS NOT NULL").groupBy(*[F.col(f"after.{k}").alias(k) for k in keys]).agg(*image)


def backfill_key(log: DataFrame, keys: list[str], columns: list[str], missing: str = "missing_before") -> DataFrame:
    """Updates whose old image lacks key columns take them from the new image."""
    old = F.struct(*[(F.coalesce(F.col(f"before.{c}"), F.col(f"after.{c}")) if c in keys else F.col(f"before.{c}")).alias(c) for c in columns])
    return log.withColumn("before", F.when(F.col("op") == "U", old).otherwise(F.col("before")))


def insert_batches(inserts: DataFrame, missing: str = "missing_after") -> DataFrame:
    """Inserts that share a column list: ``missing_count``, ``missing_map`` and how many there are, in that order."""
    names = F.array_sort(F.coalesce(missing, F.array().cast("array<string>")))
    out = inserts.groupBy(F.size(names).cast("long").alias("missing_count"), F.array_join(names, ",").alias("missing_map")).agg(F.count("*").alias("rows"))
    return out.orderBy("missing_count", "missing_map")


def pair_halves(inserts: DataFrame, deletes: DataFrame, by: list[str]) -> DataFrame:
    """Inserts beside equal deletes, one to one: the n-th of one with the n-th of the other."""
    i = running(inserts, by, "lsn", F.lit(1), "__n").withColumnRenamed("lsn", "insert_lsn")
    d = running(deletes, by, "lsn", F.lit(1), "__n").withColumnRenamed("lsn", "delete_lsn")
    return i.join(d.select(*by, "__n", "delete_lsn"), [*by, "__n"]).drop("__n")


def hashed(rows: DataFrame, columns: list[str], missing: str | None = None) -> DataFrame:
    return rows.withColumn("row_hash", row_hash([F.col(c) for c in columns], F.col(missing) if missing else None))
