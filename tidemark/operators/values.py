"""Row images out of records: multi-row inserts, large values in chunks, pruned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dictionary import as_of


def explode_multi_insert(records: DataFrame, rows: str = "rows") -> DataFrame:
    """One insert for each row image of a record; ``seq`` is its place in the record."""
    rest = [c for c in records.columns if c not in (rows, "seq")]
    return records.select(*rest, F.posexplode(rows).alias("seq", "after"))


def assemble_chunks(chunks: DataFrame, by: list[str], number: str = "chunk_no", data: str = "chunk", total: str | None = None) -> DataFrame:
    """Values put together from chunks in the order of their numbers; ``complete`` says that none is missing.

    Numbers begin at 0. ``total`` names the column with the value's size (the same in all its chunks), without which a
    lost end can't be noticed.
    """
    parts = F.array_sort(F.collect_set(F.struct(number, data)))
    value = F.array_join(F.transform(parts, lambda p: p[data]), "")
    out = chunks.groupBy(by).agg(value.alias("value"), F.count_distinct(number).alias("chunks"), F.min(number).alias("__first"), F.max(number).alias("__last"), (F.max(total) if total else F.lit(None).cast("long")).alias("__total"))
    whole = (F.col("__first") == 0) & (F.col("chunks") == F.col("__last") + 1) & (F.col("__total").isNull() | (F.length("value") == F.col("__total")))
    return out.withColumn("complete", whole).drop("__first", "__last", "__total")


def prune(columns: DataFrame, drop: tuple[str, ...] = ("dropped", "custom", "missing")) -> DataFrame:
    """Columns (relid, num, name, flag) that generated statements name."""
    return columns.where(~F.col("flag").isin(*drop))


def tuple_from_pages(images: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with the tuple that the latest full page image up to their LSN holds at their place, where they have none.

    The place is (relfilenode, block, item); an image taken after the change is of no use to it.
    """
    i = images.withColumnRenamed("tuple", "__t")
    found = as_of(changes, i, ["relfilenode", "block", "item"], "lsn", "lsn", ["__t"])
    return found.withColumn("tuple", F.coalesce("tuple", "__t")).drop("__t")


def classify(records: DataFrame) -> DataFrame:
    """Adds ``kind`` of a raw record by its resource manager and info bits (``rmgr``, ``info``)."""
    kinds = {
        ("heap", 0x00): "insert", ("heap", 0x10): "delete", ("heap", 0x20): "update", ("heap", 0x30): "truncate", ("heap", 0x40): "hot_update",
        ("heap2", 0x50): "multi_insert", ("xact", 0x00): "commit", ("xact", 0x10): "prepare", ("xact", 0x20): "abort", ("xact", 0x30): "commit_prepared",
        ("xact", 0x40): "abort_prepared", ("xlog", 0x00): "checkpoint", ("xlog", 0x10): "checkpoint_online", ("xlog", 0x90): "recovery_end",
        ("relmap", 0x00): "relmap", ("seq", 0x00): "sequence", ("standby", 0x10): "running_xacts",
    }
    out = F.lit("other")
    for (rmgr, info), kind in kinds.items():
        out = F.when((F.col("rmgr") == rmgr) & (F.col("info").bitwiseAND(F.lit(0x70 if rmgr in ("heap", "heap2", "xact") else 0xF0)) == info), kind).otherwise(out)
    return records.withColumn("kind", out)


def old_image(log: DataFrame, keys: list[str], identity: str = "identity") -> DataFrame:
    """Old images as a table's replica identity records them: full (f), key columns only (d, i), or nothing (n)."""
    columns = log.schema["before"].dataType.names
    key_only = F.struct(*[(F.col(f"before.{c}") if c in keys else F.lit(None).cast(log.schema["before"].dataType[c].dataType)).alias(c) for c in columns])
    kept = F.when(F.col(identity) == "f", F.col("before")).when(F.col(identity).isin("d", "i"), key_only)
    rest = F.array(*[F.lit(c) for c in columns if c not in keys])
    missing = F.when(F.col(identity).isin("d", "i"), rest).when(F.col(identity) == "n", F.array(*map(F.lit, columns)))
    return log.withColumns({"before": F.when(F.col("before").isNotNull(), kept), "missing_before": F.when(F.col("before").isNotNull(), missing)})


def rebuild_update(changes: DataFrame, old: str = "old", middle: str = "middle", prefix: str = "prefix", suffix: str = "suffix") -> DataFrame:
    """Adds ``tuple``: an update's new value from what it shares with the old one's start and end, and the part that is new."""
    size = F.length(old)
    tail = F.when(F.col(suffix) > 0, F.substring(F.col(old), size - F.col(suffix) + 1, F.col(suffix))).otherwise(F.substring(F.col(old), 1, F.lit(0)))
    return changes.withColumn("tuple", F.concat(F.substring(F.col(old), F.lit(1), F.col(prefix)), F.col(middle), tail))


def deform(tuples: DataFrame, columns: list[str], values: str = "values", nulls: str = "nulls", defaults: dict[str, str] | None = None) -> DataFrame:
    """A column for each attribute of a tuple: ``values`` holds those that aren't null, ``nulls`` says which are.

    A tuple that is older than a column is shorter, and takes the column's default.
    """
    defaults = defaults or {}

    def attribute(i: int, name: str):
        null = F.get(nulls, F.lit(i))
        before = F.size(F.filter(F.slice(nulls, 1, i), lambda b: ~b)) if i else F.lit(0)
        return F.when(null.isNull(), F.lit(defaults.get(name))).when(~null, F.get(values, before)).alias(name)

    rest = [c for c in tuples.columns if c not in (values, nulls)]
    return tuples.select(*rest, *[attribute(i, n) for i, n in enumerate(columns)])


def catalog_column(rows: DataFrame, positions: dict[int, dict[str, int]], name: str, version: str = "version", values: str = "values") -> DataFrame:
    """Adds ``name``: a catalog row's value at the place that the column has in the catalog's version."""
    at = F.create_map(*[x for v, places in positions.items() if name in places for x in (F.lit(v), F.lit(places[name]))])
    return rows.withColumn(name, F.get(values, F.element_at(at, F.col(version))))
