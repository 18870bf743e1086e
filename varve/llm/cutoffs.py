"""Problem 3: the cutoff per source that keeps a target share of its records, from a persistent count tree.

A score's integer code follows its order: sign, then 2^BITS steps to the octave. The tree halves the
range of codes DEPTH times; of its levels every STRIDE-th is stored, as (keys, level, node, n) rows, so
that a step of the descent chooses among 2^STRIDE nodes. A batch only adds its own node counts (with
sign -1 it takes records back), pre-aggregated by code, so a source with a third of all rows shuffles
no more than its distinct codes. The descent to a rank reads the tree alone; only the leaf that holds
the rank is refined to distinct scores from the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.session import Scratch

BITS = 10
DEPTH = 24
STRIDE = 6
MIDDLE = 1 << (DEPTH - 1)


def code(score: Column) -> Column:
    """The integer code of a score that is neither null nor NaN: greater scores never have smaller codes."""
    octave = F.greatest(F.lit(-1075.0), F.least(F.lit(1024.0), F.log2(F.abs(score))))
    step = (F.floor((octave + 1075) * (1 << BITS)) + 1).cast("long")
    return F.when(score == 0, F.lit(MIDDLE)).when(score > 0, MIDDLE + step).otherwise(MIDDLE - step).cast("long")


class CountTree:
    """Node counts of the scores of every source, kept as a table that batches are added to."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys, self.schema = spark, path, list(keys), None

    def add(self, batch: DataFrame, score: str, sign: int = 1) -> None:
        """Adds (sign 1) or takes back (sign -1) the batch's records; null and NaN scores are left out."""
        value = F.col(score).cast("double")
        leaves = batch.where(value.isNotNull() & ~F.isnan(value)).groupBy(*self.keys, code(value).alias("code")).agg(F.count("*").alias("n"))
        levels = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright("code", DEPTH - level).alias("node")) for level in range(STRIDE, DEPTH + 1, STRIDE))))
        nodes = leaves.select(*self.keys, levels.alias("at"), "n").groupBy(*self.keys, F.col("at.level").alias("level"), F.col("at.node").alias("node")).agg((F.sum("n") * sign).alias("n"))
        self.schema = nodes.schema
        nodes.write.mode("append").partitionBy("level").parquet(self.path)

    def nodes(self, level: int, below: DataFrame | None = None) -> DataFrame:
        """(keys, node, n) of a stored level; with `below` (keys, _leaf) only the nodes under these, before any counting."""
        read = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        rows = read.parquet(self.path).where(F.col("level") == level)
        if below is not None:
            rows = rows.withColumn("_leaf", F.shiftright("node", STRIDE)).join(below, [*self.keys, "_leaf"], "left_semi")
        return rows.groupBy(*self.keys, "node").agg(F.sum("n").alias("n")).where("n <> 0")

    def totals(self) -> DataFrame:
        """(keys, n): the records of every source."""
        return self.nodes(STRIDE).groupBy(*self.keys).agg(F.sum("n").alias("n"))

    def descend(self, targets: DataFrame, rank: str = "rank") -> DataFrame:
        """targets with `leaf`, the code that holds the rank (1 is the smallest), and `rest`, the rank within it.

        Targets whose rank is null, below 1 or beyond the source's records have no leaf and are left out.
        """
        at = targets.where(F.col(rank) >= 1).withColumn("_leaf", F.lit(0).cast("long")).withColumn("_rest", F.col(rank).cast("long"))
        names, scratch = at.columns, Scratch(self.spark, "descent")
        for level in range(STRIDE, DEPTH + 1, STRIDE):
            below = self.nodes(level, at.select(*self.keys, "_leaf").distinct()).select(*self.keys, F.shiftright("node", STRIDE).alias("_leaf"), F.struct("node", "n").alias("_c"))
            below = below.groupBy(*self.keys, "_leaf").agg(F.sort_array(F.collect_list("_c")).alias("_c"))
            start = F.struct(F.col("_rest").alias("rest"), F.lit(None).cast("long").alias("node"))
            step = lambda s, c: F.when(s.node.isNotNull(), s).when(c.n >= s.rest, F.struct(s.rest.alias("rest"), c.node.alias("node"))).otherwise(F.struct((s.rest - c.n).alias("rest"), F.lit(None).cast("long").alias("node")))
            at = at.join(below, [*self.keys, "_leaf"]).withColumn("_s", F.aggregate("_c", start, step)).where(F.col("_s.node").isNotNull())
            at = at.withColumn("_leaf", F.col("_s.node")).withColumn("_rest", F.col("_s.rest")).select(*names)
            at = scratch.renew(at, "at")
        return at.withColumnRenamed("_leaf", "leaf").withColumnRenamed("_rest", "rest")


def refine(targets: DataFrame, records: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """targets with `cutoff`, the distinct score at their rank, and `kept`, the number of records up to it."""
    value = F.col(score).cast("double")
    within = records.where(value.isNotNull() & ~F.isnan(value)).select(*keys, value.alias("_s"), code(value).alias("leaf"))
    wanted = targets.select(*keys, "leaf").distinct()
    counts = within.join(wanted, [*keys, "leaf"], "left_semi").groupBy(*keys, "leaf", "_s").agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*keys, "leaf").orderBy("_s"))
    runs = counts.withColumn("_up", up_to)
    hit = targets.join(runs, [*keys, "leaf"]).where((F.col("_up") >= F.col("rest")) & (F.col("_up") - F.col("_n") < F.col("rest")))
    return hit.withColumn("cutoff", F.col("_s")).withColumn("kept", F.col("rank") - F.col("rest") + F.col("_up")).drop("_s", "_n", "_up", "leaf", "rest")


def cutoffs(records: DataFrame, targets: DataFrame, keys: Sequence[str], score: str, tree: CountTree, *, add: bool = True) -> DataFrame:
    """(keys, keep_pct, n, rank, cutoff, kept) for the sources with a target.

    The cutoff is the smallest occurring score v with 100 x #(scores <= v) >= keep_pct x #(scores).
    targets: (keys, keep_pct), one row a source; a null keep_pct or one outside 0 to 100 gives no cutoff.
    add: whether the records still have to be added to the tree. Null and NaN scores do not count.
    """
    if add:
        tree.add(records, score)
    goals = targets.select(*keys, "keep_pct").where(F.col("keep_pct").between(0, 100)).join(tree.totals(), list(keys))
    ranks = goals.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("keep_pct") * F.col("n") / 100)).cast("long"))
    return refine(tree.descend(ranks), records, keys, score)
