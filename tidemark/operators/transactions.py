"""Transactions: assembly by xid, commits and aborts, bundles, sizes and log marks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def roll_up(changes: DataFrame, parents: DataFrame) -> DataFrame:
    """Changes of sub-transactions under their top parent's xid; parents: sub_xid, xid, of any depth.

    Each round doubles how far up a sub-transaction looks, until none of its parents has one.
    """
    up = parents.groupBy("sub_xid").agg(F.max("xid").alias("__top"))
    while True:
        above = up.select(F.col("sub_xid").alias("__top"), F.col("__top").alias("__above"))
        further = up.join(above, "__top", "left")
        if not further.where("__above IS NOT NULL").take(1):
            break
        up = further.select("sub_xid", F.coalesce("__above", "__top").alias("__top"))
    out = changes.join(up, changes["xid"] == up["sub_xid"], "left")
    return out.withColumn("xid", F.coalesce("__top", "xid")).drop("sub_xid", "__top")


def committed(changes: DataFrame, ends: DataFrame) -> DataFrame:
    """Changes of committed transactions, with ``commit_lsn``; ends: xid, op (C or A), lsn. Open and aborted ones wait or go."""
    e = ends.where("op = 'C'").groupBy("xid").agg(F.max("lsn").alias("commit_lsn"))
    return changes.drop("commit_lsn").join(e, "xid")


def without_aborted(changes: DataFrame, aborted: Column) -> DataFrame:
    """Changes whose transaction didn't abort."""
    return changes.where(~aborted)


def assemble(changes: DataFrame, order: str = "lsn", statements: bool = False) -> DataFrame:
    """One row for each transaction: ``statements``, first and last LSN, counts by operation.

    With ``statements`` also ``ops``, the operations in order; only for transactions of bounded size, see ``route_big``.
    """
    aggs = [F.count("*").alias("statements"), F.min(order).alias("first_lsn"), F.max(order).alias("last_lsn")]
    aggs += [F.sum(F.when(F.col("op") == o, 1).otherwise(0)).cast("long").alias(n) for o, n in (("I", "inserts"), ("U", "updates"), ("D", "deletes"))]
    if statements:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "op"))), lambda x: x["op"]), "").alias("ops"))
    return changes.groupBy("xid").agg(*aggs)


def sizes(changes: DataFrame, size: Column) -> DataFrame:
    """``size`` of each transaction: the sum of the lengths of its values."""
    return changes.groupBy("xid").agg(F.sum(size).cast("long").alias("size"))


#: Big transactions that are sent to all tasks.
FEW_BIG = 100_000


def route_big(changes: DataFrame, size: Column, threshold: int) -> DataFrame:
    """Adds ``big``: whether the transaction has ``threshold`` bytes or more and goes to a stream of its own."""
    big = sizes(changes, size).where(F.col("size") >= threshold).select("xid").withColumn("__big", F.lit(True))
    # few are big: up to FEW_BIG of them are sent to all tasks, and the log isn't shuffled a second time
    few = big.limit(FEW_BIG + 1).count() <= FEW_BIG
    return changes.join(F.broadcast(big) if few else big, "xid", "left").withColumn("big", F.coalesce("__big", F.lit(False))).drop("__big")


#: Widths, as powers of two, of the ranges of positions that running sums are made over.
RANGES = (16, 26, 36)


def fixed_bundles(transactions: DataFrame, budget: int, order: str = "last_lsn", stream: str | None = None) -> DataFrame:
    """Adds ``bundle``: statements before the transaction, divided by the budget.

    """
    out = running(transactions, [stream] if stream else [], order, F.col("statements"), "__at")
    return out.withColumn("bundle", F.floor(F.col("__at") / budget).cast("long")).drop("__at")


def running(rows: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``by`` that come before in ``order`` (a whole number).

    No task sorts all rows of a key: they are dealt into ranges of 2**16 positions, these into ranges of 2**26, and so
    on, and what comes before a range is the sum of the ranges before it within the next larger one.
    """
    rows = rows.withColumn("__v", value).withColumns({f"__r{s}": F.shiftright(F.col(order).cast("long"), s) for s in RANGES})
    inner = W.partitionBy(*by, f"__r{RANGES[0]}").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn(name, F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    sums = rows.groupBy(*by, *[f"__r{s}" for s in RANGES]).agg(F.sum("__v").alias("__v"))
    for small, large in zip(RANGES, [*RANGES[1:], None], strict=True):
        keys = [*by, f"__r{small}"]
        above = [f"__r{large}"] if large else []
        w = W.partitionBy(*by, *above).orderBy(f"__r{small}").rowsBetween(W.unboundedPreceding, -1) if by or above else W.orderBy(f"__r{small}").rowsBetween(W.unboundedPreceding, -1)
        before = sums.withColumn("__before", F.coalesce(F.sum("__v").over(w), F.lit(0))).select(*keys, "__before")
        before = before.withColumnsRenamed({k: f"__k{k}" for k in keys})
        out = out.join(before, [F.col(k).eqNullSafe(F.col(f"__k{k}")) for k in keys]).withColumn(name, F.col(name) + F.col("__before")).drop("__before", *[f"__k{k}" for k in keys])
        if large:
            sums = sums.groupBy(*by, *[f"__r{s}" for s in RANGES if s >= large]).agg(F.sum("__v").alias("__v"))
    return out.drop("__v", *[f"__r{s}" for s in RANGES])


def greedy_bundles(transactions: DataFrame, budget: int, stream: str, order: str = "last_lsn") -> DataFrame:
    """Adds ``bundle``: consecutive transactions while the sum stays below the budget; one beyond it stands alone.

    Transactions of a ``stream`` (what lies between two barriers) are folded in order over sorted rows
    that flow through a task in batches; only headers take part.
    """
    schema = transactions.schema.simpleString()[7:-1].replace(":", " ") + ", bundle bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, number = None, 0, -1
        for batch in batches:
            out = []
            for s, n in zip(batch.column(stream).to_pylist(), batch.column("statements").to_pylist(), strict=True):
                if s != at or number < 0:
                    at, used, number = s, n, 0
                elif n >= budget or used + n >= budget or used >= budget:
                    number, used = number + 1, n
                else:
                    used += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "bundle"])

    return transactions.repartition(stream).sortWithinPartitions(stream, order).mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in transactions.schema.fields) + ", bundle bigint")


def marks(transactions: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """One row: restart (oldest open start), confirm (latest committed end) and redo (latest checkpoint up to restart)."""
    state = F.col("state")
    out = transactions.agg(F.min(F.when(state == "open", F.col("first_lsn"))).alias("restart_lsn"), F.max(F.when(state == "committed", F.col("last_lsn"))).alias("confirm_lsn"))
    out = out.withColumn("restart_lsn", F.coalesce("restart_lsn", "confirm_lsn"))
    if checkpoints is None:
        return out
    # a checkpoint at or before the restart: both sides are one row after aggregation
    return out.join(checkpoints.select(F.col("lsn").alias("__c")), F.col("__c") <= F.col("restart_lsn"), "left").groupBy("restart_lsn", "confirm_lsn").agg(F.max("__c").alias("redo_lsn"))


def rewind(unfinished: DataFrame) -> DataFrame:
    """The earliest (file_id, offset) where an unfinished big transaction or refresh begins."""
    return unfinished.where("state <> 'done'").agg(F.min(F.struct("file_id", "offset")).alias("p")).select("p.file_id", "p.offset")


def rewind_checkpoint(checkpoints: DataFrame, xmin: int) -> DataFrame:
    """The latest checkpoint whose next xid isn't beyond the snapshot's xmin: where a backward search stops."""
    return checkpoints.where(F.col("next_xid") <= xmin).agg(F.max("lsn").alias("lsn"))


def reset(open_changes: DataFrame, resets: DataFrame) -> DataFrame:
    """Without changes of transactions that were open when the log was reset after them; resets: lsn."""
    last = resets.agg(F.max("lsn").alias("__reset"))
    return open_changes.join(F.broadcast(last)).where(F.col("__reset").isNull() | (F.col("lsn") > F.col("__reset"))).drop("__reset")


def abandon(changes: DataFrame, abandoned: DataFrame) -> DataFrame:
    """Without changes of abandoned transactions; abandoned: xid, lsn (of the mark). A later use of the xid stays."""
    last = abandoned.groupBy("xid").agg(F.max("lsn").alias("__mark"))
    return changes.join(last, "xid", "left").where(F.col("__mark").isNull() | (F.col("lsn") > F.col("__mark"))).drop("__mark")


def commit_order(changes: DataFrame) -> DataFrame:
    """Changes in the order of their commits, then of the log: a range-partitioned sort."""
    return changes.orderBy("commit_lsn", "lsn")
