"""The data model: a project of named tables over a long sparse count table.

counts(cell_id, gene_id, dataset, count[, norm]) holds no zeros; every aggregate that needs them takes the
number of cells from cells(cell_id, dataset, origin, experiment). A stage returns a new Project.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


log = logging.getLogger("varve")


@dataclass(frozen=True)
class Project:
    """Named tables and where stages are kept."""

    spark: SparkSession
    name: str
    path: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)

    @classmethod
    def create(cls, spark: SparkSession, datasets: Sequence[str], path: str, *, label: str | None = None, **params: object) -> Project:
        """A project named after its dataset, or `merged.` and all of them, with an optional label before it."""
        if not datasets:
            raise ValueError("a project needs at least one dataset")
        name = datasets[0] if len(datasets) == 1 else ".".join(["merged", *datasets])
        return cls(spark, f"{label}_{name}" if label else name, path, {}, dict(params))

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def having(self, **tables: DataFrame) -> Project:
        return replace(self, tables=self.tables | tables)

    def stage(self, name: str, make: Callable[[], DataFrame], **params: object) -> DataFrame:
        """The stage's table, read from its folder if it was made with the same parameters, else made and kept."""
        key = hashlib.sha256(json.dumps([name, self.params, params], sort_keys=True, default=str).encode()).hexdigest()[:16]
        folder = f"{self.path}/{self.name}/{name}-{key}"
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            began = time.time()
            make().write.mode("overwrite").parquet(folder)
            log.info("%s %s made in %.1f s", self.name, name, time.time() - began)
        return self.spark.read.parquet(folder)


def save_project(project: Project) -> str:
    """Writes every table of the project to its folder and gives the folder."""
    folder = f"{project.path}/{project.name}"
    for name, df in project.tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/tables/{name}")
    return folder


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none if it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(target) if f.isDirectory()) if system.exists(target) else []


def saved_projects(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The projects saved in a folder and the names of their tables."""
    found = {name: _folders(spark, f"{path}/{name}/tables") for name in _folders(spark, path)}
    return {name: tables for name, tables in found.items() if tables}


def load_project(spark: SparkSession, path: str, name: str, tables: Sequence[str] | None = None) -> Project:
    """A saved project with the named tables, by default all that are there."""
    chosen = _folders(spark, f"{path}/{name}/tables") if tables is None else tables
    return Project(spark, name, path, {t: spark.read.parquet(f"{path}/{name}/tables/{t}") for t in chosen})


def save_names(project: Project, names: DataFrame) -> Project:
    """The project with its clusters' names (cluster, name), which are kept in its folder."""
    names.select("cluster", "name").write.mode("overwrite").parquet(f"{project.path}/{project.name}/tables/cluster_names")
    return load_names(project)


def load_names(project: Project) -> Project:
    """The project with the names kept in its folder."""
    return project.having(cluster_names=project.spark.read.parquet(f"{project.path}/{project.name}/tables/cluster_names"))


def remove_names(project: Project) -> Project:
    """The project with its clusters as their own names; those kept in its folder stay there."""
    return project.having(cluster_names=project["member"].select("cluster").distinct().withColumn("name", F.col("cluster").cast("string")))


def first_match(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of every key in the given order, so that a look-up by it never multiplies rows."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def current(df: DataFrame, keys: Sequence[str], latest: str) -> DataFrame:
    """Of rows with equal keys the one with the greatest `latest`; rows that tie are settled by their values."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), latest).alias("_r"))
    return newest.select(*keys, *(F.col(f"_r.{c}") for c in rest))
