"""Problem 4: exact percentiles of every group by one distributed sort, and summaries that combine.

The sort with counts per partition is the core's (`varve.operators.order_statistics`): rows sorted by (group, value)
over all files, counts per file and group, and from these the places of the wanted order statistics, which alone
are read again. A group with a third of all rows lies in many files, and so does a value that many rows share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.operators.order_statistics import percentiles

__all__ = ["combine", "percentiles", "summaries"]


def summaries(rows: DataFrame, keys: Sequence[str], value: str, points: int = 100) -> DataFrame:
    """(keys, n, marks): per group its points + 1 evenly spaced order statistics, to be combined without the values."""
    spread = [i / points for i in range(points + 1)]
    marks = F.transform(F.sort_array(F.collect_list(F.struct("p", "value"))), lambda x: x.value)
    return percentiles(rows, keys, value, spread).groupBy(*keys).agg(F.max("n").alias("n"), marks.alias("marks"))


def combine(parts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, p, n, value, error): percentiles of the union of summarised parts, whose keys may be any of theirs.

    A part's marks stand for its n values in equal shares. The value's rank is off by at most `error`, a share of
    n: each part adds at most one interval between its marks, and one value.
    """
    size = F.size("marks") - 1
    shares = F.transform("marks", lambda m, i: F.struct(m.alias("v"), (F.col("n") * F.when((i == 0) | (i == size), 0.5).otherwise(1.0) / size).alias("w")))
    spread = parts.select(*keys, F.explode(shares).alias("x")).groupBy(*keys, F.col("x.v").alias("v")).agg(F.sum("x.w").alias("w"))
    group = Window.partitionBy(*keys)
    runs = spread.withColumn("up", F.sum("w").over(group.orderBy("v"))).withColumn("all", F.sum("w").over(group))
    goals = runs.select(*keys, "v", "up", "all", F.explode(F.array(*(F.lit(float(p)) for p in probs))).alias("p"))
    found = goals.where(F.col("up") >= F.col("p") * F.col("all") * (1 - 1e-12)).groupBy(*keys, "p").agg(F.min("v").alias("value"))
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") / size + 1).alias("_e")).select(*keys, "n", (F.col("_e") / F.col("n")).alias("error"))
    return found.join(whole, list(keys)).select(*keys, "p", "n", "value", "error")
