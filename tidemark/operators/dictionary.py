"""The versioned dictionary of tables and columns, and lookups of changes in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_lsn

#: Rows that an as-of lookup sorts key by key; more are dealt into ranges.
RANGE_ROWS = 1_000_000


def resolve(changes: DataFrame, key: str, levels: list[DataFrame], value: str) -> DataFrame:
    """Adds ``value`` from the first level (transaction-local, history, global) that knows ``key``.

    A level may have ``xid``; then it is seen by that transaction only.
    """
    out, names = changes, []
    for i, level in enumerate(levels):
        by = [key, "xid"] if "xid" in level.columns else [key]
        names.append(f"__v{i}")
        out = out.join(level.groupBy(by).agg(F.max(value).alias(names[-1])), by, "left")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def enrich(changes: DataFrame, *dictionaries: tuple[DataFrame, str]) -> DataFrame:
    """Left joins of dictionary tables, each on its key."""
    return reduce(lambda d, x: d.join(x[0], x[1], "left"), dictionaries, changes)


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], range_width: int | None = None) -> DataFrame:
    """``left`` with the values of the latest row of ``right`` at or before it, of the same ``by``.

    The two sides are laid together, sorted once within ``by``, and the latest values carried forward:
    no pair of rows is made. A key may hold a large part of all rows, so each key's rows are dealt into ranges of
    ``range_width`` (of a whole number, or seconds of a time), each sorted on its own; what a range begins with comes
    from one row for each key and range. By default the width follows the positions, and RANGE_ROWS rows or fewer
    are one range.
    """
    l_rows = left.select(*[F.col(b).alias(f"__b_{b}") for b in by], F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(_struct(right, values)).alias("__v"))
    r_rows = right.select(*[F.col(b).alias(f"__b_{b}") for b in by], F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(l_rows.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__v"))
    keys = [f"__b_{b}" for b in by]
    both = l_rows.unionByName(r_rows)
    order = [F.col("__at"), F.col("__side")]
    place = _place(F.col("__at"), left.schema[left_at].dataType)
    if range_width is None and place is not None:
        low, high, n = both.agg(F.min(place), F.max(place), F.count("*")).first()
        if n > RANGE_ROWS:
            range_width = max(1, (high - low) // (8 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if range_width is None or place is None:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        out = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    else:
        both = both.withColumn("__range", F.floor(place / range_width))
        ends = both.groupBy(*keys, "__range").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__at"))).alias("__end"))
        earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
        begins = ends.withColumn("__begin", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
        begins = begins.withColumnsRenamed({k: f"__r{k}" for k in [*keys, "__range"]})
        joined = both.join(begins, [F.col(k).eqNullSafe(F.col(f"__r{k}")) for k in [*keys, "__range"]], "left")
        w = W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        out = joined.withColumn("__last", F.coalesce(F.last("__v", ignorenulls=True).over(w), F.col("__begin")))
    return out.where("__side = 1").select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def _place(at: Column, kind: T.DataType) -> Column | None:
    """A whole number that follows the order of ``at``, or None."""
    if isinstance(kind, T.IntegralType):
        return at.cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60 + F.second(at)
    return F.unix_date(at).cast("long") * 86_400 if isinstance(kind, T.DateType) else None


def _struct(df: DataFrame, values: list[str]) -> str:
    return "struct<" + ",".join(f"`{v}`:{df.schema[v].dataType.simpleString()}" for v in values) + ">"


def parse_history(spark: SparkSession, path: str) -> DataFrame:
    """``timeline, begin_lsn, end_lsn`` from a timeline history file's lines ``timeline<TAB>HI/LO<TAB>reason``; the last one's end is open.

    Such a file has a line for each switch of the server, so it is read and numbered on one machine.
    """
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    rows = spark.read.text(path).select(F.split(line, r"\s+").alias("p")).where(F.size("p") >= 2)
    ends = rows.select(F.col("p")[0].cast("int").alias("timeline"), parse_lsn(F.col("p")[1]).alias("end_lsn"))
    w = W.orderBy("end_lsn")
    known = ends.withColumn("begin_lsn", F.lag("end_lsn", 1, 0).over(w)).select("timeline", "begin_lsn", "end_lsn")
    last = ends.agg((F.max("timeline") + 1).alias("timeline"), F.coalesce(F.max("end_lsn"), F.lit(0)).alias("begin_lsn"), F.lit(None).cast("long").alias("end_lsn"))
    return known.unionByName(last.where("timeline IS NOT NULL"))


def in_range(left: DataFrame, ranges: DataFrame, at: str, begin: str = "begin_lsn", end: str = "end_lsn", limit_rows: int = 10_000) -> DataFrame:
    """``left`` with the range that holds ``at`` (begin inclusive, end exclusive or null for open).

    Ranges that don't overlap, as timelines are: up to ``limit_rows`` of them are sent to every task after
    they were counted; more are found as an as-of lookup over range buckets instead.
    """
    if ranges.limit(limit_rows + 1).count() <= limit_rows:
        r = F.broadcast(ranges)
        return left.join(r, (F.col(at) >= F.col(begin)) & (F.col(end).isNull() | (F.col(at) < F.col(end))), "left")
    one = ranges.withColumn("__all", F.lit(0))
    names = [c for c in ranges.columns]
    found = as_of(left.withColumn("__all", F.lit(0)), one, ["__all"], at, begin, names).drop("__all")
    inside = F.col(end).isNull() | (F.col(at) < F.col(end))
    return found.select(*left.columns, *[F.when(inside, F.col(c)).alias(c) for c in names])


def apply_history(dictionary: DataFrame, history: DataFrame, key: str = "oid") -> DataFrame:
    """The dictionary after entries (key, lsn, op I/U/D, and its columns): the last entry of a key decides."""
    columns = dictionary.columns
    last = history.groupBy(key).agg(F.max_by(F.struct("op", *[c for c in columns if c != key]), "lsn").alias("h"))
    d = dictionary.select(F.col(key).alias("__k"), F.struct(*columns).alias("__old"))
    out = d.join(last, F.col("__k") == F.col(key), "full_outer").where("h IS NULL OR h.op <> 'D'")
    return out.select(*[F.when(F.col("h").isNull(), F.col(f"__old.{c}")).otherwise(F.col(key) if c == key else F.col(f"h.{c}")).alias(c) for c in columns])


def drop_dependants(dependants: DataFrame, dictionary: DataFrame, key: str = "oid") -> DataFrame:
    """Rows of a dependent catalog whose table is still there."""
    return dependants.join(dictionary.select(key), key, "left_semi")


def real_oids(changes: DataFrame, moved: DataFrame, key: str = "relid", prefix: str = "pg_temp_") -> DataFrame:
    """``changes`` whose ``key`` is a table that rewrites another for a while, under the oid of the other.

    moved: oid, name; the name of such a table is the prefix and the real oid. Others are left out; up to
    as many rows as catalogs have tables under rewrite are sent to all tasks after a count.
    """
    real = moved.where(F.col("name").rlike(f"^{prefix}[0-9]+$")).select(F.col("oid").alias("__temp"), F.substring("name", len(prefix) + 1, 20).cast("long").alias("__real"))
    few = real.limit(10_001).count() <= 10_000
    out = changes.join(F.broadcast(real) if few else real, F.col(key) == F.col("__temp"), "left")
    return out.withColumn(key, F.coalesce("__real", key)).drop("__temp", "__real")


def history_entries(changes: DataFrame, catalogs: dict[str, str]) -> DataFrame:
    """Dictionary entries of catalog row changes: ``catalog`` (by table name), op, lsn, xid, image."""
    kinds = F.create_map(*[F.lit(x) for kv in catalogs.items() for x in kv])
    image = F.when(F.col("op") == "D", F.col("before")).otherwise(F.col("after"))
    return changes.where(F.col("table").isin(*catalogs)).select("lsn", "xid", "op", F.element_at(kinds, F.col("table")).alias("catalog"), image.alias("image"))


def key_columns(indexes: DataFrame) -> DataFrame:
    """The key of each table: the index of the replica identity, or else the primary, or else the first unique one."""
    rank = F.when(F.col("identity"), 0).when(F.col("primary"), 1).when(F.col("unique"), 2)
    return indexes.where(rank.isNotNull()).groupBy("relid").agg(F.min_by("columns", F.struct(rank, "index_oid")).alias("key_cols"))
