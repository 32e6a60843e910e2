"""Sources: points from Parquet, CSV, NPY, white-space text and sparse triplets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def points(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, features, label) of any table with a vector column."""
    label = F.col(label_col) if label_col else F.lit(0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("features"), label.cast("int").alias("label"))


def parquet_points(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    return points(spark.read.parquet(path), **columns)


def csv_points(spark: SparkSession, path: str, label_col: int = 1, first_feature: int = 2) -> DataFrame:
    """A CSV with header: a column of row numbers, the label, then features. Columns are
    typed by place, so the file is read once."""
    df = spark.read.csv(path, header=True)
    names = df.columns
    features = F.array(*[F.col(f"`{c}`").cast("float") for c in names[first_feature:]])
    return df.select(F.col(f"`{names[0]}`").cast("long").alias("id"), features.alias("features"), F.col(f"`{names[label_col]}`").cast("int").alias("label"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    from terrakin.operators.index import numbered

    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    return numbered(lines, ["_at"], "id")


def text_points(spark: SparkSession, path: str, labels_path: str | None = None) -> DataFrame:
    """Lines of numbers between white space; labels from a file of one number a line."""
    rows = _numbered_lines(spark, path).select("id", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("float")).alias("features"))
    if labels_path is None:
        return rows.withColumn("label", F.lit(0))
    labels = _numbered_lines(spark, labels_path).select("id", F.trim("value").cast("double").cast("int").alias("label"))
    return rows.join(labels, "id", "left")


def npy_points(spark: SparkSession, path: str, labels_path: str | None = None, block: int = 65_536) -> DataFrame:
    """A matrix in NumPy's format. The files are mapped on the driver and passed on by
    blocks; convert large ones to Parquet first."""
    x = np.load(path, mmap_mode="r")
    y = np.load(labels_path, mmap_mode="r") if labels_path else None
    out = None
    for a in range(0, max(1, len(x)), block):
        part = [(a + k, [float(v) for v in row], int(y[a + k]) if y is not None else 0) for k, row in enumerate(x[a : a + block])]
        df = spark.createDataFrame(part, "id long, features array<float>, label int")
        out = df if out is None else out.union(df)
    return out


def market_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val), from 0, of a sparse matrix in Matrix Market coordinates."""
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("%")))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") == 3)
    entry: Column = F.struct((F.col("p")[0].cast("long") - 1).alias("row"), (F.col("p")[1].cast("long") - 1).alias("col"), F.col("p")[2].cast("double").alias("val"))
    # The first line that is no comment gives the sizes: both sizes bound all entries.
    first = spark.read.text(path).filter(~F.startswith("value", F.lit("%"))).first()
    size = first[0].strip() if first else ""
    return parts.filter(F.concat_ws(" ", "p") != F.lit(" ".join(size.split()))).select(entry.alias("e")).select("e.*")


def ten_x(spark: SparkSession, folder: str, batch: str) -> DataFrame:
    """(batch, cell, gene, n) of a 10X folder: matrix.mtx(.gz), genes.tsv, barcodes by place."""
    entries = market_matrix(spark, f"{folder}/matrix.mtx*").withColumnsRenamed({"row": "gene_at", "col": "cell"})
    genes = _numbered_lines(spark, f"{folder}/genes.tsv*").select(F.col("id").alias("gene_at"), F.element_at(F.split("value", "\t"), -1).alias("gene"))
    return entries.join(genes, "gene_at").select(F.lit(batch).alias("batch"), "cell", "gene", F.col("val").alias("n"))


def shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet shards of one table under each other, by column name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)
