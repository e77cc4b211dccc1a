"""Tables on shared storage: scratch tables that cut lineage, and versioned sets of tables that readers never see half done."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, else one in the warehouse."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparrowfold-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sparrowfold")
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


class Scratch:
    """A folder of its own under the shared root, gone when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._leave)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table: what made it isn't run again, and lost executors cost a read."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _leave(self) -> None:
        with contextlib.suppress(Exception):
            fs, path = _fs(self.spark, self.root)
            fs.delete(path, True)


class Conflict(RuntimeError):
    """Another writer took the place that a version was to have."""


class Version:
    """One published set of tables; what a reader holds stays as it is, whatever is published meanwhile."""

    def __init__(self, spark: SparkSession, path: str, number: int, facts: dict):
        self.spark, self.path, self.number, self.facts = spark, path, number, facts

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


class Store:
    """Versions of a set of tables under one folder.

    Tables go to a folder of their own first. Then a file that names it is moved to _versions/<number>, which no one
    has: that is the publication, in one step. Readers take the highest number, once, so a writer that fails before
    that step, or is still at work, changes nothing for them; two writers can't take one number.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self) -> list[int]:
        fs, path = _fs(self.spark, f"{self.root}/_versions")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())

    def write(self, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> str:
        """The tables in a new folder that no reader knows yet."""
        folder = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            writer = df.write.mode("errorifexists")
            if column := (partition_by or {}).get(name):
                writer = writer.partitionBy(column)
            writer.parquet(f"{self.root}/{folder}/{name}")
        return folder

    def commit(self, folder: str, facts: dict | None = None, after: int | None = None) -> Version:
        """Makes a written folder the current version; with `after`, only if that is still the current number."""
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        if after is not None and after != last:
            raise Conflict(f"version {last} has come after {after}")
        jvm = self.spark.sparkContext._jvm
        fs, draft = _fs(self.spark, f"{self.root}/{folder}/_pointer")
        out = fs.create(draft, True)
        try:
            out.write(json.dumps({"folder": folder, "facts": facts or {}}).encode())
        finally:
            out.close()
        _, place = _fs(self.spark, f"{self.root}/_versions/{last + 1:012d}")
        fs.mkdirs(place.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(place), kinds)
        except Exception as e:
            if fs.exists(place):
                raise Conflict(f"another writer has published version {last + 1}") from e
            raise
        return Version(self.spark, f"{self.root}/{folder}", last + 1, facts or {})

    def publish(self, tables: dict[str, DataFrame], facts: dict | None = None, partition_by: dict[str, str] | None = None) -> Version:
        return self.commit(self.write(tables, partition_by), facts)

    def current(self) -> Version:
        """The version to read from, once for all tables of a query; none raises."""
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no version has been published under {self.root}")
        return self._at(numbers[-1])

    def _at(self, number: int) -> Version:
        fs, path = _fs(self.spark, f"{self.root}/_versions/{number:012d}")
        at = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8")
        finally:
            at.close()
        said = json.loads(text)
        return Version(self.spark, f"{self.root}/{said['folder']}", number, said["facts"])

    def prune(self, keep: int = 2) -> list[str]:
        """Removes all but the last versions, and folders that never became one; their names. For when no writer is at work."""
        numbers = self._numbers()
        held = {self._at(n).path.rsplit("/", 1)[-1] for n in numbers[-keep:]}
        fs, root = _fs(self.spark, self.root)
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in held]
        for n in numbers[:-keep]:
            fs.delete(_fs(self.spark, f"{self.root}/_versions/{n:012d}")[1], False)
        for path in gone:
            fs.delete(path, True)
        return sorted(p.getName() for p in gone)
