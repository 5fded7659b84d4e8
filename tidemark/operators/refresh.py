"""Loading tables: shards, snapshots with concurrent changes, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .apply import merge
from .compact import compact
from .filters import concurrent_with_snapshot


def plan_shards(tables: DataFrame, pages_per_shard: int) -> DataFrame:
    """``shard`` (from 1), ``total``, ``first_page`` and ``end_page`` for each table (``pages`` of it); an empty table is one shard (0, 0)."""
    total = F.greatest(F.floor((F.col("pages") - 1) / pages_per_shard).cast("long") + 1, F.lit(1))
    out = tables.withColumn("total", F.when(F.col("pages") <= 0, F.lit(1).cast("long")).otherwise(total))
    out = out.withColumn("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total"))))
    first = (F.col("shard") - 1) * pages_per_shard
    return out.withColumns({"first_page": F.when(F.col("pages") <= 0, 0).otherwise(first).cast("long"), "end_page": F.when(F.col("pages") <= 0, 0).otherwise(F.least(first + pages_per_shard, F.col("pages"))).cast("long")})


def shard_progress(shards: DataFrame) -> DataFrame:
    """Per table: ``total``, ``complete`` and its status (WAIT, SYNCING or DONE); shards: table, state."""
    done, busy = F.sum((F.col("state") == "done").cast("long")), F.sum((F.col("state") != "wait").cast("long"))
    out = shards.groupBy("table").agg(F.count("*").alias("total"), done.alias("complete"), busy.alias("__busy"))
    return out.select("table", "total", "complete", F.when(F.col("complete") == F.col("total"), "DONE").when(F.col("__busy") > 0, "SYNCING").otherwise("WAIT").alias("status"))


def conflicts(refreshes: DataFrame) -> DataFrame:
    """Refreshes (uuid, seq, table, state) that must wait: an earlier unfinished one shares a table."""
    a, b = refreshes.alias("a"), refreshes.where("state <> 'done'").alias("b")
    hit = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("b.seq") < F.col("a.seq")))
    return hit.groupBy(F.col("a.uuid").alias("uuid")).agg(F.max("b.seq").alias("waits_for"))


def with_increment(snapshot: DataFrame, log: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """A table's snapshot and the changes that it doesn't hold, merged: the state when the refresh ends."""
    return merge(snapshot, compact(log, keys, order), keys)


def online_increment(log: DataFrame, xmin: int, xmax: int, in_progress: list[int], refresh_xid: int) -> DataFrame:
    """Changes that run beside an online refresh and that its snapshot lacks."""
    return log.where(concurrent_with_snapshot(F.col("xid"), xmin, xmax, in_progress, refresh_xid))


def parse_snapshot(text: str) -> tuple[int, int, list[int]]:
    """xmin, xmax and the transactions in progress of ``xmin:xmax:xip,...``."""
    lo, hi, running = text.split(":")
    return int(lo), int(hi), [int(x) for x in running.split(",") if x]


def add_to_dataset(dataset: DataFrame, refreshed: DataFrame) -> DataFrame:
    """The dataset with a refresh's tables."""
    return dataset.union(refreshed.select(dataset.columns)).distinct()
