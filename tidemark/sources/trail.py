"""Change logs as numbered Parquet folders, targets as versioned tables, and progress, on any Hadoop file system."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_shard_name
from ..schema import change_schema


class Folder:
    """A folder reached through Hadoop's file system, so local disks and object stores are alike."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self._path(self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.path}/{name}"))

    def write_text(self, name: str, text: str) -> None:
        """Written beside and renamed, so that a reader never sees half a file."""
        tmp, to = self._path(f"{self.path}/.{name}.tmp"), self._path(f"{self.path}/{name}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        # one step that also replaces an older file: there is no moment without either
        sc = self.spark.sparkContext
        jvm = sc._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), sc._jsc.hadoopConfiguration()).rename(self.fs.makeQualified(tmp), self.fs.makeQualified(to), how)

    def read_text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        return "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}"), True)


#: Rows of a trail's file, so that a task sorts no more of them however long the log is.
FILE_ROWS = 500_000


def trail_files(log: DataFrame, least: int = 1) -> int:
    """How many files a log takes, by a count of its rows."""
    return max(least, -(-log.count() // FILE_ROWS))


def write_trail(log: DataFrame, folder: str, files: int = 1, whole: bool = True) -> None:
    """Appends a log's rows, range-partitioned by commit so that each file holds a stretch of the log.

    whole: a commit lies in one file. If not, it may lie in several: no task sorts all of a big transaction, but a
    stream must then take all files at once (``files_per_trigger``), as an apply leaves out commits that it has had.
    """
    if whole:
        ranges = log.repartitionByRange(files, "commit_lsn")
    else:
        # rows may share an LSN, too: what has no order is dealt by where it stands in the input
        ranges = log.withColumn("__nth", F.monotonically_increasing_id()).repartitionByRange(files, "commit_lsn", "lsn", "__nth").drop("__nth")
    ranges.sortWithinPartitions("commit_lsn", "lsn").write.mode("append").parquet(folder)


def read_trail(spark: SparkSession, folder: str, image: T.DataType | None = None, after: int | None = None) -> DataFrame:
    """The log's rows; ``after`` (a commit LSN) reaches the Parquet scan as a filter."""
    log = spark.read.schema(change_schema(image)).parquet(folder)
    return log if after is None else log.where(F.col("commit_lsn") > after)


def read_with_archive(spark: SparkSession, primary: str, archive: str, image: T.DataType | None = None) -> DataFrame:
    """The log of two folders: a file that the primary no longer has is read from the archive."""
    there = Folder(spark, primary).names()
    older = [n for n in Folder(spark, archive).names() if n not in set(there) and not n.startswith(("_", "."))]
    paths = [f"{primary}/{n}" for n in there if not n.startswith(("_", "."))] + [f"{archive}/{n}" for n in older]
    return spark.read.schema(change_schema(image)).parquet(*paths)


def broken_links(records: DataFrame, file: str = "file_id", at: str = "lsn", before: str = "prev_lsn") -> DataFrame:
    """Records whose back pointer isn't the record before them; files are checked on their own, and at their seams."""
    w = W.partitionBy(file).orderBy(at)
    inner = records.withColumn("__prev", F.lag(at).over(w))
    ends = records.groupBy(file).agg(F.max(at).alias("__end")).withColumn(file, F.col(file) + 1)
    seams = inner.join(ends, file, "left").withColumn("__prev", F.coalesce("__prev", "__end"))
    return seams.where(F.col("__prev").isNotNull() & (F.col("__prev") != F.col(before))).select(records.columns)


def catalog_snapshot(spark: SparkSession, database: str) -> DataFrame:
    """The columns of a database's tables: schema, table, attnum, name, type, not_null; a small table made on the driver."""
    rows = [
        (database, t.name, i, c.name, c.dataType, not c.nullable)
        for t in spark.catalog.listTables(database)
        if not t.isTemporary
        for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"), 1)
    ]
    return spark.createDataFrame(rows, "schema string, table string, attnum int, name string, type string, not_null boolean")


def read_table_shards(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, shards: int, **options: str) -> DataFrame:
    """A database table over JDBC, ``shards`` ranges of a numeric key in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(shards))
    return reader.options(**options).load()


def stream_trail(spark: SparkSession, folder: str, image: T.DataType | None = None, files_per_trigger: int = 64) -> DataFrame:
    """The log as a stream: new files as they come, so many for each micro-batch."""
    return spark.readStream.schema(change_schema(image)).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


class TargetTable:
    """A table in buckets of its key's hash, and in versions: an apply rewrites the buckets that it meets and no others.

    A version is a small file ``CURRENT-<number>`` that is renamed into place when its data are there: it names the
    folder of each bucket and holds the progress, so data and progress never disagree. The greatest number counts;
    a crash before the rename leaves the version before. A batch that was applied already is recognised by its id.
    source: ``schema.table`` of the changes that are for this table; without it a log must be of one table.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], keep: int = 2, buckets: int = 16, source: str | None = None):
        self.spark, self.keys, self.keep, self.buckets, self.source = spark, keys, keep, buckets, source
        self.folder = Folder(spark, path)

    def _versions(self) -> list[int]:
        return sorted(int(n.removeprefix("CURRENT-")) for n in self.folder.names() if n.startswith("CURRENT-"))

    def _manifest(self, version: int) -> dict:
        return json.loads(self.folder.read_text(f"CURRENT-{version:012d}"))

    def state(self) -> dict:
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {"version": -1, "batch": -1, "lsn": -1, "xid": -1, "places": {}, "schema": None}

    def of_bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the current version, or of some of its buckets."""
        state = self.state()
        if state["schema"] is None:
            raise ValueError("the table was never written")
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.folder.path}/{place}/__bucket={b}" for b, place in state["places"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, batch: int = -1, lsn: int = -1, xid: int = -1, buckets: list[int] | None = None) -> None:
        """A version in which the rows of ``buckets`` (all if not given) are ``rows``."""
        state = self.state()
        batch = max(batch, state["batch"])
        version = state["version"] + 1
        place = f"v{version}"
        # a large bucket is written by several tasks, small ones share a task
        rows.withColumn("__bucket", self.of_bucket()).hint("rebalance", "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.folder.path}/{place}")
        new = {n.removeprefix("__bucket="): place for n in Folder(self.spark, f"{self.folder.path}/{place}").names() if n.startswith("__bucket=")}
        old = {} if buckets is None else {b: p for b, p in state["places"].items() if int(b) not in buckets}
        manifest = {"version": version, "batch": batch, "lsn": lsn, "xid": xid, "places": {**old, **new}, "schema": rows.schema.json()}
        self.folder.write_text(f"CURRENT-{version:012d}", json.dumps(manifest))
        self._clean()

    def _clean(self) -> None:
        """Drops versions beyond the last ``keep``, and buckets that none of these names."""
        versions = self._versions()
        for v in versions[: -self.keep]:
            self.folder.delete(f"CURRENT-{v:012d}")
        used = {(p, b) for v in versions[-self.keep :] for b, p in self._manifest(v)["places"].items()}
        for place in [n for n in self.folder.names() if n.startswith("v")]:
            if int(place[1:]) > versions[-1] or any(p == place for p, _ in used):
                for n in Folder(self.spark, f"{self.folder.path}/{place}").names():
                    if n.startswith("__bucket=") and int(place[1:]) <= versions[-1] and (place, n.removeprefix("__bucket=")) not in used:
                        self.folder.delete(f"{place}/{n}")
            else:
                self.folder.delete(place)

    def truncate(self) -> None:
        state = self.state()
        self.write(self.read().limit(0), state["batch"], state["lsn"], state["xid"])


class Staging:
    """Rows that wait under a number of their own: a big transaction's by its xid, an online refresh's increment by its uuid.

    They are read or dropped as a whole. Each batch writes a folder that it overwrites when it is replayed.
    """

    def __init__(self, spark: SparkSession, path: str, by: str = "xid"):
        self.spark, self.by = spark, by
        self.folder = Folder(spark, path)

    def stage(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy(self.by).parquet(f"{self.folder.path}/batch-{batch}")

    def _parts(self, number: object) -> list[str]:
        name = f"{self.by}={number}"
        return [f"{b}/{name}" for b in self.folder.names() if b.startswith("batch-") and self.folder.exists(f"{b}/{name}")]

    def read(self, number: object) -> DataFrame | None:
        """The staged rows, with their number again; None if there are none."""
        parts = self._parts(number)
        return self.spark.read.parquet(*[f"{self.folder.path}/{p}" for p in parts]).withColumn(self.by, F.lit(number)) if parts else None

    def drop(self, number: object) -> None:
        for p in self._parts(number):
            self.folder.delete(p)

    def waiting(self) -> list[str]:
        names = {n for b in self.folder.names() if b.startswith("batch-") for n in Folder(self.spark, f"{self.folder.path}/{b}").names()}
        return sorted(n.removeprefix(f"{self.by}=") for n in names if n.startswith(f"{self.by}="))


def shard_queue(spark: SparkSession, folder: str, done: DataFrame | None = None) -> DataFrame:
    """``name, schema, table, total, number`` of the shard files in a folder that aren't done yet; done: schema, table, number."""
    names = [(n,) for n in Folder(spark, folder).names() if not n.startswith(("_", "."))]
    found = spark.createDataFrame(names, "name string").withColumn("p", parse_shard_name(F.col("name"))).where("p IS NOT NULL").select("name", "p.*")
    return found if done is None else found.join(done.select("schema", "table", "number"), ["schema", "table", "number"], "left_anti").select(found.columns)


def read_table_list(spark: SparkSession, path: str) -> DataFrame:
    """``schema, table`` of a text file's lines ``schema.table``; blank lines and comments (#) don't count."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> ''").select("line", F.split("line", r"\.").alias("p"))
    return rows.select(F.when(F.size("p") == 2, F.trim(F.col("p")[0])).otherwise(F.raise_error(F.concat(F.lit("not schema.table: "), "line"))).alias("schema"), F.trim(F.get("p", F.lit(1))).alias("table")).distinct()


def write_dictionary(catalogs: dict[str, DataFrame], folder: str) -> None:
    """The dictionary's catalogs (class, attribute, type, ...), one Parquet folder each."""
    for name, rows in catalogs.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_dictionary(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in Folder(spark, folder).names() if not n.startswith(("_", "."))}
