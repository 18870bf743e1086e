"""Readers and writers of count matrices and gene lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(at, name): a file's lines numbered from 1 in file order.

    A partition's lines are consecutive; its number of lines and those of the partitions before it give the places.
    """
    lines = spark.read.text(path).select(F.col("value").alias(name), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    # the parts of a file come in no given order, their offsets in the file do
    lines = lines.withColumns({"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start")})
    parts = lines.groupBy("_file", "_from", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    return lines.join(F.broadcast(starts.select("_file", "_from", "_first", "_before")), ["_file", "_from"]).select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("at"), name)


def read_matrix_market(spark: SparkSession, folder: str, dataset: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, genes, cells) of a folder with matrix.mtx, genes.tsv (id, symbol) and barcodes.tsv.

    Entries of the same place are summed, as the format's assembly does; explicit zeros are dropped.
    """
    parts = F.split(F.trim("value"), r"\s+")
    cells = _numbered(spark, f"{folder}/barcodes.tsv", "line").select(F.col("at").alias("cell_id"), F.trim(F.element_at(F.split("line", "\t"), 1)).alias("barcode"), F.lit(dataset).alias("dataset"))
    fields = F.split("line", "\t")
    genes = _numbered(spark, f"{folder}/genes.tsv", "line").select(F.col("at").cast("int").alias("gene_id"), F.trim(F.element_at(fields, 2)).alias("symbol"))
    lines = spark.read.text(f"{folder}/matrix.mtx").select("value", F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"))
    lines = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = lines.where("_from = 0").first()  # the first line that is no comment tells the size, and may look like an entry
    triples = lines.where((F.col("_from") != 0) | (F.col("_id") != (size["_id"] if size else -1))).select(parts[0].cast("int").alias("gene_id"), parts[1].cast("bigint").alias("cell_id"), parts[2].cast("double").alias("count"))
    counts = triples.groupBy("cell_id", "gene_id").agg(F.sum("count").alias("count")).where("count <> 0").withColumn("dataset", F.lit(dataset))
    return counts, genes, cells


def read_text_matrix(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, genes, cells) of a dense whitespace table: a header of cell labels, then a symbol and values a line.

    Labels may repeat; cells and genes are numbered in file order. Zeros are dropped.
    """
    rows = _numbered(spark, path, "line").where(F.trim("line") != "").withColumn("f", F.split(F.trim("line"), r"\s+"))
    head = rows.where("at = 1")
    cells = head.select(F.posexplode("f").alias("i", "label")).select((F.col("i") + 1).cast("bigint").alias("cell_id"), "label", F.lit(dataset).alias("dataset"))
    body = rows.where("at > 1").withColumn("gene_id", (F.col("at") - 1).cast("int"))
    genes = body.select("gene_id", F.col("f")[0].alias("symbol"))
    values = body.select("gene_id", F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("i", "v"))
    counts = values.select((F.col("i") + 1).cast("bigint").alias("cell_id"), "gene_id", F.col("v").cast("double").alias("count")).where("count <> 0")
    return counts.withColumn("dataset", F.lit(dataset)), genes, cells


def long_table(df: DataFrame, cell: str, gene: str, value: str, dataset: str | None = None) -> DataFrame:
    """An in-memory table as counts(cell_id, gene_id, dataset, count), without zeros and nulls (S3)."""
    label = F.col(dataset) if dataset else F.lit("all")
    rows = df.groupBy(F.col(cell).alias("cell_id"), F.col(gene).alias("gene_id"), label.alias("dataset")).agg(F.sum(value).cast("double").alias("count"))
    return rows.where("count <> 0")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(at, symbol): a text file's non-empty lines, numbered in file order."""
    rows = _numbered(spark, path, "symbol").select(F.col("at"), F.trim("symbol").alias("symbol")).where("symbol <> ''")
    return rows.select(F.row_number().over(Window.orderBy("at")).alias("at"), "symbol")


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """A result as CSV with a header, sorted within its files."""
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)
