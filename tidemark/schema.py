"""The change log's schema and the states of a value in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, DELETE, UPDATE, TRUNCATE, DDL = "I", "D", "U", "T", "DDL"
BEGIN, COMMIT, ABORT, RESET = "B", "C", "A", "RESET"
REFRESH_BEGIN, REFRESH_END, REFRESH_INCREMENT_END = "RB", "RE", "RI"
BIG_BEGIN, BIG_END = "XB", "XE"
ROW_OPS = (INSERT, DELETE, UPDATE)
#: Operations that end a segment of compaction.
BARRIERS = (TRUNCATE, DDL, REFRESH_BEGIN, REFRESH_END, REFRESH_INCREMENT_END, BIG_BEGIN, BIG_END, RESET)


def change_schema(image: T.DataType | None = None) -> T.StructType:
    """The log's columns; ``image`` is the type of a row before and after a change (text by name if not given)."""
    image = image or T.MapType(T.StringType(), T.StringType())
    names = T.ArrayType(T.StringType())
    return T.StructType(
        [
            T.StructField("lsn", T.LongType(), False),
            T.StructField("commit_lsn", T.LongType()),
            T.StructField("xid", T.LongType()),
            T.StructField("seq", T.IntegerType()),
            T.StructField("op", T.StringType(), False),
            T.StructField("relid", T.LongType()),
            T.StructField("schema", T.StringType()),
            T.StructField("table", T.StringType()),
            T.StructField("before", image),
            T.StructField("after", image),
            T.StructField("missing_before", names),
            T.StructField("missing_after", names),
            T.StructField("key_cols", names),
            T.StructField("commit_ts", T.TimestampType()),
            T.StructField("payload", T.StringType()),
        ]
    )


def is_missing(column: str, missing: str = "missing_after") -> Column:
    """Whether the log didn't record a column, as opposed to recording a null."""
    return F.coalesce(F.array_contains(missing, column), F.lit(False))
