"""Preparation of count tables: (cell, gene, n) with a batch per cell, one row per non-zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WORD = "[a-z]+"


def counts(docs: DataFrame) -> DataFrame:
    """(batch, cell, gene, n) of documents: lower-cased words as genes, sources as batches."""
    words = docs.select(F.coalesce("source", F.lit("")).alias("batch"), F.col("doc_id").alias("cell"), F.explode(F.expr(f"regexp_extract_all(lower(coalesce(text, '')), '{WORD}', 0)")).alias("gene"))
    return words.groupBy("batch", "cell", "gene").agg(F.count(F.lit(1)).alias("n"))


def library_sizes(c: DataFrame) -> DataFrame:
    return c.groupBy("batch", "cell").agg(F.sum("n").alias("size"))


def library_size_filter(sizes: DataFrame, low: float = 0.20, high: float = 0.75) -> DataFrame:
    """Cells above the ``low`` quantile of their batch, and of those the cells below the
    ``high`` quantile of what is left."""
    cut = lambda df, p: df.groupBy("batch").agg(F.percentile("size", F.lit(p)).alias("cut"))
    kept = sizes.join(cut(sizes, low), "batch").filter("size > cut").drop("cut")
    return kept.join(cut(kept, high), "batch").filter("size < cut").drop("cut")


def rare_gene_filter(c: DataFrame, min_cells: int = 10) -> DataFrame:
    """Counts of genes that at least ``min_cells`` cells have."""
    common = c.groupBy("gene").agg(F.count_distinct("cell").alias("cells")).filter(F.col("cells") >= min_cells)
    return c.join(common.select("gene"), "gene", "left_semi")


def library_normalized(c: DataFrame, scale: float = 10_000.0) -> DataFrame:
    """Counts as shares of their cell, times ``scale``."""
    size = F.sum("n").over(Window.partitionBy("batch", "cell"))  # one read of the counts
    return c.select("batch", "cell", "gene", (F.col("n") / size * scale).alias("value"))


def square_root(c: DataFrame) -> DataFrame:
    return c.withColumn("value", F.sqrt("value"))


def gene_set_filter(c: DataFrame, prefix: str, quantile: float = 0.90) -> DataFrame:
    """Cells whose counts of genes that begin with ``prefix`` lie below the quantile."""
    held = c.groupBy("batch", "cell").agg(F.sum(F.when(F.startswith("gene", F.lit(prefix)), F.col("n")).otherwise(0)).alias("held"))
    return held.filter(F.col("held") < held.agg(F.percentile("held", F.lit(quantile))).scalar())


def label_encoded(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Whole numbers from 0 for the distinct values in their order. The values are numbered
    by themselves, so rows are never ordered in one task."""
    from terrakin.operators.index import numbered

    codes = numbered(df.select(column).filter(F.col(column).isNotNull()).distinct(), [column], name)
    return df.join(codes, column, "left")


def batch_union(batches: dict[str, DataFrame]) -> DataFrame:
    """All batches with their names."""
    out = None
    for name, df in batches.items():
        one = df.withColumn("batch", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def to_vectors(points: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return points.withColumn("vector", array_to_vector(F.transform("features", lambda x: x.cast("double"))))


def pca(points: DataFrame, k: int = 50) -> DataFrame:
    """``points`` with features replaced by their k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = to_vectors(points)
    model = PCA(k=k, inputCol="vector", outputCol="parts").fit(v)
    return model.transform(v).withColumn("features", vector_to_array("parts")).drop("vector", "parts")


def kmeans(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``points`` with a ``cluster`` each, for choosing a selection."""
    from pyspark.ml.clustering import KMeans

    v = to_vectors(points)
    return KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster").fit(v).transform(v).drop("vector")


def l2_normalized_rows(points: DataFrame) -> DataFrame:
    from terrakin.functions.vectors import doubles, l2_normalized

    return points.withColumn("features", l2_normalized(doubles(F.col("features"))))
