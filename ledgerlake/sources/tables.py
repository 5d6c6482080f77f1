"""Reading and maintaining partitioned tables of a lake folder.

Tables are Parquet, partitioned by user_id. A table without a transaction log cannot delete rows
in place: a replacement writes the partitions that it touches anew in a folder of its own (a swap),
then moves the old ones aside and the new ones in. A failure before the swap is complete
leaves the table as it was; one after that is made good by recover, which goes on where the
moves stopped, so the table is never without the old or the new rows for good. One writer at a time
is assumed; a reader during the moves may find partitions missing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake.sources.schemas import SCHEMAS


class Lake:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType] = SCHEMAS, partition: tuple[str, ...] = ("user_id",)):
        self.spark, self.root, self.schemas, self.partition = spark, root.rstrip("/"), schemas, partition

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._fs()
        return fs.exists(path(self.path(name)))

    def tables(self) -> dict[str, DataFrame]:
        """The tables that are there: a store, to be held against another one."""
        return {name: self.read(name) for name in self.schemas if self.exists(name)}

    def read(self, name: str, user_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """The table, or an empty one of its schema if it is not there; user_id prunes to one partition."""
        schema = self.schemas[name]
        df = self.spark.read.schema(schema).parquet(self.path(name)) if self.exists(name) else self.spark.createDataFrame([], schema)
        if user_id is not None:
            df = df.where(F.col("user_id") == user_id)
        return df.select(*(columns or schema.names))

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows with the table's columns and types. A row without a user is refused: it has no partition."""
        user = F.when(F.col("user_id").isNull(), F.raise_error(F.lit("a row has no user_id"))).otherwise(F.col("user_id"))
        typed = rows.withColumn("user_id", user) if "user_id" in self.schemas[name].names else rows
        return typed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name]))

    def append(self, name: str, rows: DataFrame) -> None:
        self._typed(name, rows).write.mode("append").partitionBy(*self.partition).parquet(self.path(name))

    def _mark(self, file: str) -> None:
        path, fs = self._fs()
        fs.create(path(file)).close()

    def _folders(self, folder: str) -> list[str]:
        """Names of the partitions below a folder."""
        path, fs = self._fs()
        return [x.getPath().getName() for x in fs.listStatus(path(folder)) if x.isDirectory()] if fs.exists(path(folder)) else []

    def _swap(self, name: str, rows: DataFrame, touched: DataFrame | None) -> None:
        """Put rows in place of the partitions of the touched (user_id), who lose theirs if they have no
        rows; of the whole table if touched is None. Which they are is written as folders, not collected."""
        self.recover()
        swap = f"{self.root}/_swap-{name}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*self.partition).parquet(f"{swap}/new")
        if touched is not None:
            touched.select("user_id", F.lit(1).alias("touched")).distinct().write.partitionBy("user_id").parquet(f"{swap}/touched")
        self._mark(f"{swap}/READY")
        self._finish(name, swap)

    def _finish(self, name: str, swap: str) -> None:
        """Make the moves of a complete swap; those already made are passed over."""
        path, fs = self._fs()
        table, there = self.path(name), lambda x: fs.exists(path(x))
        fs.mkdirs(path(f"{swap}/old"))
        if not there(f"{swap}/MOVED"):  # nothing new has been moved in, so what is there is old
            for part in self._folders(f"{swap}/touched") if there(f"{swap}/touched") else self._folders(table):
                if there(f"{table}/{part}") and not there(f"{swap}/old/{part}"):
                    fs.rename(path(f"{table}/{part}"), path(f"{swap}/old/{part}"))
            self._mark(f"{swap}/MOVED")
        fs.mkdirs(path(table))
        for part in self._folders(f"{swap}/new"):
            fs.rename(path(f"{swap}/new/{part}"), path(f"{table}/{part}"))
        fs.delete(path(swap), True)

    def recover(self) -> None:
        """Finish the swaps that were complete when their writer failed, remove those that were not."""
        path, fs = self._fs()
        for folder in self._folders(self.root):
            if folder.startswith("_swap-"):
                swap = f"{self.root}/{folder}"
                if fs.exists(path(f"{swap}/READY")):
                    self._finish(folder.removeprefix("_swap-").rpartition("-")[0], swap)
                else:
                    fs.delete(path(swap), True)

    def delete(self, name: str, gone: Column) -> None:
        """Delete by predicate, in the partitions that have such rows."""
        table, gone = self.read(name), F.coalesce(gone, F.lit(False))
        touched = table.where(gone).select("user_id").distinct()
        self._swap(name, table.where(~gone).join(touched, "user_id", "left_semi"), touched)

    def replace_by_key(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """The rows take the place of all that share their (user_id, keys): files, month keys, runs."""
        rows = self._typed(name, rows)
        touched = rows.select("user_id").distinct()
        old = self.read(name).join(touched, "user_id", "left_semi").join(rows.select("user_id", *keys).distinct(), ["user_id", *keys], "left_anti")
        self._swap(name, old.select(*rows.columns).unionByName(rows), touched)

    def replace_users(self, name: str, rows: DataFrame, users: list[str] | None = None) -> None:
        """The rows take the place of everything of their users, and of the named users who have none."""
        rows = self._typed(name, rows)
        touched = rows.select("user_id").distinct()
        if users is not None:
            named = self.spark.createDataFrame([(u,) for u in users], "user_id string")
            rows, touched = rows.join(F.broadcast(named), "user_id", "left_semi").select(*rows.columns), named
        self._swap(name, rows, touched)

    def rebuild(self, name: str, rows: DataFrame) -> None:
        """The rows become the table: a full rebuild."""
        self._swap(name, self._typed(name, rows), None)

    def replace_group(self, tables: dict[str, DataFrame], users: list[str]) -> None:
        """Several tables of the same users together; a table without rows is cleared."""
        for name, rows in tables.items():
            self.replace_users(name, rows, users)

    def register_files(self, files: DataFrame) -> None:
        """Add to the registry only the files it does not have."""
        known = self.read("ingested_files").select("user_id", "file_sha256")
        self.append("ingested_files", files.dropDuplicates(["user_id", "file_sha256"]).join(known, ["user_id", "file_sha256"], "left_anti"))


def merge_movements(silver: DataFrame, bronze: DataFrame, keys: list[str], file: str = "source_file", version: str = "ingested_at") -> DataFrame:
    """The next state of an incrementally kept table.

    New are the bronze rows of files that silver does not have in that version. Silver rows of
    such files, and of files that bronze no longer has, go first. Of rows that share a business
    key the newest version stays, then the first file, so a second run changes nothing."""
    new = bronze.join(silver.select(file, version).distinct(), [file, version], "left_anti")
    changed, present = new.select(file).distinct(), bronze.select(file).distinct()
    kept = silver.join(changed, file, "left_anti").join(present, file, "left_semi")
    order = Window.partitionBy(*keys).orderBy(F.desc(version), file)
    every = kept.select(*silver.columns).unionByName(new.select(*silver.columns))
    return every.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == 1).drop("__r")


def new_files(seen: DataFrame, inbox: DataFrame, sha: str = "file_sha256") -> DataFrame:
    return inbox.join(seen.select(sha), sha, "left_anti")


def file_versions(files: DataFrame) -> DataFrame:
    """Files (name, file_sha256, content_key, arrived) with a verdict: duplicate (those bytes came
    before), same_content (that content came before), version (the name is taken) or new, and the
    version number under the name."""
    by = lambda *c: Window.partitionBy(*c).orderBy("arrived", "file_sha256")
    ranked = files.withColumns({"same": F.row_number().over(by("file_sha256")), "twin": F.row_number().over(by("content_key"))})
    real = (F.col("same") == 1) & (F.col("twin") == 1)
    version = F.sum(real.cast("int")).over(by("name").rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("version", F.when(real, version))
    verdict = F.when(F.col("same") > 1, "duplicate").when(F.col("twin") > 1, "same_content").when(F.col("version") > 1, "version").otherwise("new")
    return out.withColumn("verdict", verdict).drop("same", "twin")
