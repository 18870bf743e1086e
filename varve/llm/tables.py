"""The project's tables as the problems read them: current rows, usable values, normal forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.session import table


def cell_sources(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, dataset, origin), one row a cell; null datasets are left out."""
    cells = table(spark, d, "cells").where("cell_id is not null and dataset is not null")
    return cells.groupBy("cell_id").agg(F.max("dataset").alias("dataset"), F.max("origin").alias("origin"))


def cell_values(spark: SparkSession, d: str, extra: tuple[str, ...] = (), loads: DataFrame | None = None) -> DataFrame:
    """(cell_id, dataset, origin, extra, field_name, score): the current values of cells with a dataset that are
    not null, not NaN and above zero. loads: the loads of confounders to go by, by default all."""
    latest = F.max_by(F.struct("numi", "ngenes", *extra), "loaded_at").alias("c")
    current = (table(spark, d, "confounders") if loads is None else loads).groupBy("cell_id").agg(latest)
    rows = current.join(cell_sources(spark, d), "cell_id")
    fields = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"c.{f}").cast("double").alias("score")) for f in ("numi", "ngenes")))
    out = rows.select("cell_id", "dataset", "origin", *(F.col(f"c.{e}") for e in extra), F.explode(fields).alias("x"))
    return out.select("cell_id", "dataset", "origin", *extra, "x.field_name", "x.score").where("score > 0 and not isnan(score)")


def current_tests(spark: SparkSession, d: str) -> DataFrame:
    """diffexp with contrast_group without outer blanks and in lower case."""
    return table(spark, d, "diffexp").withColumn("contrast_group", F.lower(F.trim("contrast_group")))
