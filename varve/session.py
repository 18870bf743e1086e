"""Session, table access and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "varve", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tested with; `conf` overrides them (dots as `__`)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if cpus:
        builder = builder.master(f"local[{cpus}]")
        settings = {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g"} | settings
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where none is set, a local master gets a temporary folder (tests); on a cluster that raises, as executors could not
    read each other's tables.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-varve-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def open_parquet(path: str):
    """A file of the shared folder, opened in a task for its footer and single row groups."""
    from urllib.parse import unquote

    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    if path.startswith("file:"):
        system, inner = fs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    else:
        system, inner = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(inner))


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor.

    A table is named within one Scratch; saving under a used name makes a new folder, so that a plan
    may read the old one while the new one is written. `renew` and `drop` remove tables no plan needs any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.last: dict[str, str] = {}
        self.made: list[str] = []

    def path(self, name: str) -> str:
        self.count += 1
        self.last[name] = f"{self.root}/{name}-{self.count}"
        self.made.append(self.last[name])
        return self.last[name]

    def write(self, df: DataFrame, name: str, **options: str) -> str:
        """Write and give the path."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        return path

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write and read back."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, name, **options))

    def renew(self, df: DataFrame, name: str) -> DataFrame:
        """Write, read back, and remove the table last saved under the name: no plan but `df` may still read that."""
        gone = self.last.get(name)
        new = self.save(df, name)
        if gone:
            self.drop(gone)
        return new

    def settle(self) -> None:
        """Has Spark remove the shuffle files of finished plans, which it does when the driver collects its garbage; that frees the driver's heap too."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *paths: str) -> None:
        """Removes tables that no plan needs any more."""
        jvm = self.spark.sparkContext._jvm
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
