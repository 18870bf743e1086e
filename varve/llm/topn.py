"""Problem 1: the N best rows of every group, by statistics-guided skipping.

`build` writes the rows once, clustered by group and, within a file, by falling score, with a table of what each row
group's footer says of it; `top` answers queries from that layout, for all groups or some, and any n, as often as
asked. Row groups are read in rounds, for every group those of highest
maximum first; after each round, a row group is skipped for good if its maximum lies strictly below
the N-th score its group has by then. A row group that touches several groups holds the head of at
least one of them, so those are read in the first round.

Hot groups are spread over files by the range partitioning: its key goes on after the group (with the
row's identity where rows have versions, else with the score), so no task holds a whole group, and a
file hands on at most N rows of a group for each row group that is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.session import Scratch, open_parquet

ROW_GROUP_ROWS = 20_000
FIRST_WIDTH = 1


def _zones(spark: SparkSession, path: str, group: Sequence[str], score: str, types: dict[str, T.DataType]) -> DataFrame:
    """One row per row group of the written files: its place, its group if it holds only one, its top score."""
    fields = [T.StructField("_path", T.StringType()), T.StructField("_part", T.IntegerType()), T.StructField("_one", T.BooleanType())]
    schema = T.StructType([*fields, *(T.StructField(g, types[g]) for g in group), T.StructField("_top", T.DoubleType())])

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                meta = open_parquet(file).metadata
                at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
                for part in range(meta.num_row_groups):
                    info = meta.row_group(part)
                    stats = {c: info.column(at[c]).statistics for c in (*group, score)}
                    one = all(s is not None and s.has_min_max and s.null_count == 0 and s.min == s.max for s in (stats[g] for g in group))
                    top = stats[score].max if stats[score] is not None and stats[score].has_min_max else float("inf")
                    rows.append({"_path": file, "_part": part, "_one": one, "_top": float(top)} | {g: stats[g].max if one else None for g in group})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(footers, schema)


def _heads(zones: DataFrame, group: Sequence[str], n: int, schema: T.StructType, tasks: int) -> DataFrame:
    """Reads the given row groups and keeps of each its first n rows of every group (they lie in order)."""
    columns = schema.fieldNames()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for file, part in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                rows = open_parquet(file).read_row_group(part, columns=columns).select(columns)
                if not rows.num_rows:
                    continue
                starts = np.zeros(rows.num_rows, bool)
                starts[0] = True
                for g in group:
                    codes = rows.column(g).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    starts[1:] |= codes[1:] != codes[:-1]
                begin = np.maximum.accumulate(np.where(starts, np.arange(rows.num_rows), 0))
                kept = rows.filter(pa.array(np.arange(rows.num_rows) - begin < n))
                yield from kept.cast(arrow).combine_chunks().to_batches()

    return zones.select("_path", "_part").repartition(tasks, "_path", "_part").mapInArrow(read, schema)


@dataclass(frozen=True)
class Layout:
    """Rows written by group and falling score: their folder, the table of their row groups, and what they are sorted by."""

    path: str
    schema: T.StructType
    group: Sequence[str]
    score: str
    best: Sequence[Column]

    def zones(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/zones")


def build(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    ties: Sequence[Column],
    *,
    keep: Sequence[str] = (),
    version: tuple[Sequence[str], str] | None = None,
    row_group_rows: int = ROW_GROUP_ROWS,
    path: str | None = None,
) -> Layout:
    """The layout of df's rows with a finite score, in the given folder (by default one in the shared folder); see `top_n`."""
    if not group:
        raise ValueError("top_n needs at least one group column")
    spark = df.sparkSession
    identity, latest = version or ((), None)
    columns = list(dict.fromkeys([*group, *identity, score, *keep]))
    rows = df.select(*columns, *([latest] if latest and latest not in columns else []))
    if version:
        rows = rows.repartitionByRange(*group, *identity)
        newest = Window.partitionBy(*group, *identity).orderBy(F.col(latest).desc_nulls_last(), *(F.col(c) for c in columns))
        rows = rows.withColumn("_v", F.row_number().over(newest)).where("_v = 1").select(*columns)
    value = F.col(score).cast("double")
    usable = rows.withColumn(score, value).where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    best = [F.col(score).desc(), *ties, *(F.col(c) for c in (*identity, *keep))]
    if not version:
        usable = usable.repartitionByRange(*group, *best)
    folder = path or Scratch(spark, "topn").path("layout")
    limits = {"parquet.block.row.count.limit": str(row_group_rows), "parquet.page.row.count.limit": "5000"}
    usable.sortWithinPartitions(*group, *best).write.options(**limits).parquet(f"{folder}/rows")
    types = {f.name: f.dataType for f in usable.schema.fields}
    falling = Window.partitionBy(F.when(~F.col("_one"), F.col("_path")), *group).orderBy(F.desc("_top"), "_path", "_part")
    turn = F.when(F.col("_one"), F.row_number().over(falling)).otherwise(0)
    _zones(spark, f"{folder}/rows", group, score, types).withColumn("_turn", turn).write.parquet(f"{folder}/zones")
    return Layout(folder, usable.schema, list(group), score, best)


def top(spark: SparkSession, layout: Layout, n: int, groups: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The n rows of highest score of every group, with their `place`, and the numbers of rounds, row groups, and those read.

    groups: (group columns) of the groups asked for, by default all; row groups of others are not read.
    """
    scratch, group = Scratch(spark, "top"), layout.group
    zones, named = layout.zones(spark), [F.col(g).alias(f"_{g}") for g in group]
    count = zones.count()
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    asked = scratch.save(groups.select(*named).distinct(), "asked") if groups is not None else None
    if asked is not None:
        zones = zones.where(~F.col("_one")).unionByName(zones.where("_one").join(asked, same, "left_semi"))
    tasks = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = Window.partitionBy(*group).orderBy(*layout.best)
    width, rounds, read, result = FIRST_WIDTH, 0, 0, None
    due = scratch.save(zones.where(F.col("_turn") <= width), "due")
    while True:
        found = _heads(due, group, n, layout.schema, tasks)
        if asked is not None:
            found = found.join(asked, same, "left_semi")
        every = found if result is None else result.drop("place").unionByName(found)
        result = scratch.renew(every.withColumn("place", F.row_number().over(places)).where(F.col("place") <= n), "best")
        rounds, read = rounds + 1, read + due.count()
        floor = result.groupBy(*named).agg(F.min(layout.score).alias("_floor"), F.count("*").alias("_have"))
        left = zones.where(F.col("_turn") > width).join(floor.where(F.col("_have") >= n), same, "left")
        left = scratch.renew(left.where(F.col("_floor").isNull() | (F.col("_top") >= F.col("_floor"))).select("_path", "_part", "_turn"), "left")
        if left.isEmpty():
            return result, {"rounds": rounds, "row_groups": count, "read": read}
        done, width = width, width * 4
        due = scratch.renew(left.where(F.col("_turn").between(done + 1, width)), "due")


def top_n(df: DataFrame, group: Sequence[str], score: str, ties: Sequence[Column], n: int, **how) -> DataFrame:
    """The n rows of highest `score` of every group, with their `place` (1 to n): `build` and `top` in one.

    ties: order expressions that settle equal scores; rows equal in all of them are settled by `keep`, in order.
    keep: further columns of the result. Other columns of df are not read.
    version: (identity, latest): of rows that agree in the group and these identity columns only the one
      with the greatest `latest` counts, and only afterwards are unusable scores left out.
    Rows whose score is null, NaN or infinite take no part. A null in a group column is a value of its
    own. Groups with fewer rows give all of them; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "topn")
    layout = build(df, group, score, ties, path=scratch.path("layout"), **how)
    found, _ = top(df.sparkSession, layout, n)
    scratch.drop(layout.path)
    return found
