"""Exact percentiles of every group by one distributed sort.

The rows are range-partitioned by (group, value, salt), sorted within partitions and written; a row's index in its
file is then its place. Counts per file and group give every group's offset in every file, so the files and
indexes of the wanted order statistics are known, and only the row groups that hold one are read again. The salt
deals the copies of one value, which are interchangeable, over as many files as they fill: neither a group nor a
value with a third of all rows lies in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.session import Scratch, open_parquet

ROW_GROUP_ROWS = 50_000


def located(rows: DataFrame, keys: Sequence[str], value: str, salt: Sequence[str] | None = None) -> tuple[str, DataFrame]:
    """The folder of the sorted rows, and per file and group (keys, _file, _start, _cnt, _off, n).

    salt: the columns whose hash deals equal values to files, by default all of rows. It is a function of the row, so a
    recomputed task deals alike; rows equal in all of these columns stay together.
    """
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    mixed = F.xxhash64(*(rows.columns if salt is None else salt)) if salt is None or salt else F.lit(0)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    plain = rows.where(v.isNotNull() & ~F.isnan(v)).select(*named, v.alias("_v"), mixed.alias("_salt"))
    names = [f"_k{i}" for i in range(len(keys))]
    dealt = plain.repartitionByRange(*names, "_v", "_salt").drop("_salt").sortWithinPartitions(*names, "_v")
    path = Scratch(spark, "sorted").write(dealt, "rows", **{"parquet.block.row.count.limit": str(ROW_GROUP_ROWS)})
    back = spark.read.schema(dealt.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    pieces = back.groupBy(*names, "_file").agg(F.min("_row").alias("_start"), F.count("*").alias("_cnt"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    group = Window.partitionBy(*names)
    # files meet in one value at most; those wholly of it come before the one that goes on
    offset = F.sum("_cnt").over(group.orderBy("_low", "_high", "_file").rowsBetween(Window.unboundedPreceding, -1))
    return path, pieces.select(*names, "_file", "_start", "_cnt", F.coalesce(offset, F.lit(0)).alias("_off"), F.sum("_cnt").over(group).alias("n"))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values at the asked rows of every file, from the row groups that hold any of them."""
    for batch in batches:
        for file, rows in zip(batch.column("_file").to_pylist(), batch.column("rows"), strict=True):
            wanted = np.unique(rows.values.to_numpy())
            source = open_parquet(file)
            ends = np.cumsum([source.metadata.row_group(i).num_rows for i in range(source.metadata.num_row_groups)])
            part = np.searchsorted(ends, wanted, side="right")
            for i in np.unique(part):
                at = wanted[part == i]
                found = source.read_row_group(int(i), columns=["_v"]).column("_v").take(pa.array(at - (ends[i - 1] if i else 0)))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array(at, pa.int64()), found.combine_chunks()], names=["_file", "_row", "_v"])


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], salt: Sequence[str] | None = None) -> DataFrame:
    """(keys, p, n, value): exact percentiles, linear between neighbouring order statistics.

    Null and NaN values do not count; a group without other values, and an empty table, give no row. A null in a key is
    a group of its own. keys may be empty. salt: as in `located`.
    """
    spark = rows.sparkSession
    _, pieces = located(rows, keys, value, salt)
    names = [f"_k{i}" for i in range(len(keys))]
    place = lambda p: (F.col("n") - 1) * p
    end = lambda p, at: F.struct(p.alias("p"), (place(p) - F.floor(place(p))).alias("f"), at(place(p)).cast("long").alias("at"))
    ends = F.flatten(F.transform(F.array(*(F.lit(float(p)) for p in dict.fromkeys(probs))), lambda p: F.array(end(p, F.floor), end(p, F.ceil))))
    every = pieces.select(*names, "n", "_file", "_start", "_cnt", "_off", F.explode(F.array_distinct(ends)).alias("w"))
    some = every.where((F.col("w.at") >= F.col("_off")) & (F.col("w.at") < F.col("_off") + F.col("_cnt")))
    wanted = Scratch(spark, "sorted").save(some.select(*names, "n", "w.p", "w.f", "_file", (F.col("_start") + F.col("w.at") - F.col("_off")).alias("_row")), "wanted")
    asked = wanted.groupBy("_file").agg(F.collect_set("_row").alias("rows")).repartition(spark.sparkContext.defaultParallelism, "_file")
    read = asked.mapInArrow(_values, "_file string, _row bigint, _v double")
    low, high = F.min("_v"), F.max("_v")
    found = wanted.join(read, ["_file", "_row"]).groupBy(*names, "p").agg(F.max("n").alias("n"), (low + F.max("f") * (high - low)).alias("value"))
    return found.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), "p", "n", "value")


def wide(found: DataFrame, keys: Sequence[str], **names: float) -> DataFrame:
    """(keys, n, names): the long percentiles with one column per named probability."""
    at = [F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(c) for c, p in names.items()]
    return (found.groupBy(*keys) if keys else found.groupBy()).agg(F.max("n").alias("n"), *at)
