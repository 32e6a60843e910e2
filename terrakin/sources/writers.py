"""Sinks: layouts and timing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_layout(layout: DataFrame, path: str, dataset: str, technique: str, it: int) -> None:
    """CSV files by dataset, technique, iteration and level; a run's own files are replaced."""
    out = layout.select(F.lit(dataset).alias("dataset"), F.lit(technique).alias("technique"), F.lit(it).alias("it"), "level", "label", "x", "y", F.col("orig_id").alias("ind"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "technique", "it", "level").csv(path, header=True)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="label int, x double, y double, ind long, dataset string, technique string, it int, level int")


def log_line(spark: SparkSession, path: str, **values: str | int | float | bool) -> None:
    """Add a line to a log of such lines: timings, or the parameters of a study's runs."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{name} {kinds[type(v)]}" for name, v in values.items())
    spark.createDataFrame([tuple(values.values())], schema).coalesce(1).write.mode("append").csv(path)


def log_seconds(spark: SparkSession, path: str, technique: str, phase: str, seconds: float) -> None:
    """Add a line to a timing log."""
    log_line(spark, path, technique=technique, phase=phase, seconds=float(seconds))
