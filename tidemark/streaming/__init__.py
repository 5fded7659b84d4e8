"""Applying a change log as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.apply import merge
from ..operators.compact import after_truncate, compact
from ..operators.filters import filter_tables
from ..sources.trail import Staging, TargetTable


def _of_target(target: TargetTable, rows: DataFrame) -> DataFrame:
    if target.source is None:
        return rows
    schema, table = target.source.split(".")
    return rows.where((F.col("table") == table) & (F.col("schema") == schema if "schema" in rows.columns else F.lit(True)))


def apply_batch(target: TargetTable, rows: DataFrame, batch: int = -1) -> bool:
    """One batch of committed changes into ``target``; false if it, or all that it holds, was applied before.

    Only changes of the target's source are taken. Changes up to the applied commit LSN are left out, so a batch may be
    replayed. A truncate counts from its place in the order of commits on. The buckets that the changes meet
    are rewritten, and no others.
    """
    state = target.state()
    if 0 <= batch <= state["batch"]:
        return False
    at = F.struct("commit_lsn", "lsn")
    new = _of_target(target, rows).where(F.col("commit_lsn") > state["lsn"]).withColumn("__at", at)
    last = new.agg(
        F.max("commit_lsn").alias("lsn"),
        F.max_by("xid", "commit_lsn").alias("xid"),
        F.max(F.when(F.col("op") == "T", 1).otherwise(0)).alias("truncates"),
        (F.min("table") != F.max("table")).alias("several"),
    ).first()
    if last["lsn"] is None:
        return False
    if target.source is None and last["several"]:
        raise ValueError("the batch has changes of several tables: name the target's source")
    if last["truncates"]:
        net = compact(after_truncate(new, "__at"), target.keys, ["commit_lsn", "lsn"])
        target.write(merge(target.read().limit(0), net, target.keys), batch, last["lsn"], last["xid"])
        return True
    net = compact(new, target.keys, ["commit_lsn", "lsn"])
    # at most as many numbers as the table has buckets
    met = [r["b"] for r in net.select(target.of_bucket().alias("b")).distinct().collect()]
    target.write(merge(target.read(met), net, target.keys), batch, last["lsn"], last["xid"], met)
    return True


def apply_with_big(target: TargetTable, rows: DataFrame, staged: Staging, batch: int = -1) -> int:
    """One batch whose big transactions were staged apart: they are applied at their end (op XE), in the order of commits.

    What committed before a big transaction's end is applied first, then the transaction as a commit of its own,
    which also moves the progress, and then what follows. A mark of an abandoned transaction (op ABANDON) drops its staged
    rows. Returns the number of big transactions applied. Only the marks come to the driver.
    """
    if 0 <= batch <= target.state()["batch"]:
        return 0
    marks = rows.where(F.col("op").isin("XE", "ABANDON")).select("commit_lsn", "xid", "op").orderBy("commit_lsn").collect()
    plain = rows.where(~F.col("op").isin("XB", "XE", "ABANDON"))
    applied = 0
    for m in marks:
        if m["op"] == "XE" and (big := staged.read(m["xid"])) is not None:
            apply_batch(target, plain.where(F.col("commit_lsn") < m["commit_lsn"]))
            apply_batch(target, big.withColumn("commit_lsn", F.lit(m["commit_lsn"])))
            applied += 1
    apply_batch(target, plain, batch)
    for m in marks:
        staged.drop(m["xid"])
    return applied


def start_apply(log: DataFrame, target: TargetTable, checkpoint: str, available_now: bool = True, rules: Callable[[], tuple[list[str], list[str]]] | None = None) -> StreamingQuery:
    """Follows a stream of committed changes; a restart goes on from the checkpoint and replays nothing twice.

    rules: gives the include and exclude patterns of table names that hold now; it is asked for each batch, so a
    reload takes effect with the next one.
    """

    def each(rows: DataFrame, batch: int) -> None:
        if rules is not None:
            include, exclude = rules()
            rows = filter_tables(rows, include=include, exclude=exclude)
        apply_batch(target, rows, batch)

    writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def assemble_stream(changes: DataFrame, most_open: int = 1_000_000) -> DataFrame:
    """``xid, statements, first_lsn, commit_lsn, ops`` of each transaction as its commit row (op C) comes; an abort (A) drops it.

    changes: xid, lsn, op. The state of an open transaction is its count, first LSN and operations in
    arrival order of batches; a transaction beyond ``most_open`` rows belongs in a stream of its own.
    """

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, first, ops = state.get if state.exists else (0, None, "")
        rows = pd.concat(list(batches)).sort_values("lsn", kind="stable")
        for op, lsn in zip(rows["op"], rows["lsn"], strict=True):
            if op == "C":
                state.remove() if state.exists else None
                yield pd.DataFrame({"xid": [key[0]], "statements": [n], "first_lsn": [first], "commit_lsn": [lsn], "ops": [ops]})
                return
            if op == "A":
                state.remove() if state.exists else None
                return
            if n >= most_open:
                raise ValueError(f"transaction {key[0]} is too large; route it to a stream of its own")
            n, first, ops = n + 1, int(lsn) if first is None else first, ops + op
        state.update((n, first, ops))

    return changes.groupBy("xid").applyInPandasWithState(run, "xid long, statements long, first_lsn long, commit_lsn long, ops string", "n long, first long, ops string", "append", "NoTimeout")
