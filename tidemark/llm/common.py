"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session names none and runs on one machine.

    On a cluster each machine has a temporary folder of its own, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, without lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with more than this share of all rows is hot, so there are at most as many hot keys as the number.
HOT_SHARE = 2000
#: Keys with fewer rows are never hot.
HOT_ROWS = 200
#: A lookup table of so many rows at most goes to all tasks whole.
FEW_KEYS = 2_000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``keyed`` (but ``weight``) by the columns ``on``; ``how``: inner, left, left_semi or left_anti.

    ``keyed`` was computed already and has one row for each key, with the number of rows that hold it (or a bound
    of it) as ``weight``. With ``left_anti`` the rows stay whose key it lacks. FEW_KEYS keys or fewer go to all tasks. Of more, hot keys, HOT_SHARE at most as their weights say, go to all tasks, so their rows stay where
    they are; the rows of all other keys are joined by a shuffle, in which no key is large. Keys are never null.
    """
    keys, total, most = keyed.agg(F.count("*"), F.sum(weight), F.max(weight)).first()
    if keys <= FEW_KEYS:
        return rows.join(F.broadcast(keyed.drop(weight)), on, how)
    limit = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return rows.join(keyed.drop(weight), on, how)
    hot = F.broadcast(keyed.where(F.col(weight) > limit))
    cold = keyed.where(F.col(weight) <= limit).drop(weight)
    if how == "left_anti":
        return rows.join(hot.select(on), on, how).join(cold, on, how)
    there = rows.join(hot.drop(weight), on, "left_semi" if how == "left_semi" else "inner")
    return there.unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on, how))


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, text`` of rows with an id: rows are told apart by id and the hash of their text; null text is empty.

    Rows that repeat an id with another text are documents of their own; rows that repeat both are one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of up to ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end
