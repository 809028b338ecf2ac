"""Conversion between document formats as tables: what the target can't carry, and the report of what is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: places of a property that a report names.
PLACES = 8


def style_fates(styles: DataFrame, target: DataFrame) -> DataFrame:
    """styles (doc_id, name) with fate: replaced where the target defines that name (in any case), else created."""
    own = target.select(F.lower("name").alias("n_"), F.lit(True).alias("there_")).distinct()
    return styles.join(own, F.lower("name") == F.col("n_"), "left").select(*styles.columns, F.when(F.col("there_"), "replaced").otherwise("created").alias("fate"))


def dropped(properties: DataFrame, capabilities: DataFrame) -> DataFrame:
    """properties (doc_id, line, key, value) that capabilities (key) lacks."""
    return properties.join(capabilities.select("key").distinct(), "key", "left_anti").select(*properties.columns)


def loss_report(properties: DataFrame, capabilities: DataFrame, keeps: DataFrame) -> DataFrame:
    """(doc_id, what, n, places): dropped properties by key, with their first lines, and placeholders (doc_id, line, kind)
    by kind. Lines are counted and ranked first, so that a list never holds more than PLACES of them."""
    lost = dropped(properties, capabilities).select("doc_id", F.concat(F.lit("property "), "key").alias("what"), "line")
    all_ = lost.unionByName(keeps.select("doc_id", F.concat(F.lit("placeholder "), "kind").alias("what"), "line"))
    per_line = all_.groupBy("doc_id", "what", "line").agg(F.count("*").alias("n"))
    ranked = per_line.withColumn("k_", F.row_number().over(Window.partitionBy("doc_id", "what").orderBy("line")))
    first = F.array_sort(F.collect_list(F.when(F.col("k_") <= PLACES, F.col("line"))))
    return ranked.groupBy("doc_id", "what").agg(F.sum("n").alias("n"), F.array_join(first, ",").alias("places"))


def lossless(report: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, lossless)"""
    return docs.select("doc_id").join(report.select("doc_id").distinct().withColumn("lost_", F.lit(True)), "doc_id", "left").select("doc_id", F.col("lost_").isNull().alias("lossless"))
