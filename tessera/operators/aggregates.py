"""Aggregates of sheets: conditional sums, ranges, types of columns, censuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.formula import criterion


def sumifs(df: DataFrame, target: str | None, criteria: dict[str, float | str]) -> Column:
    """The aggregate of SUMIFS (or COUNTIFS, with no target) with constant criteria."""
    kinds, cond = dict(df.dtypes), F.lit(True)
    for c, crit in criteria.items():
        cond &= F.coalesce(criterion(F.col(c), kinds[c], crit), F.lit(False))
    return F.count_if(cond) if target is None else F.coalesce(F.sum(F.when(cond, F.col(target))), F.lit(0.0))


def per_row_sumifs(df: DataFrame, source: DataFrame, keys: dict[str, str], target: str | None, name: str) -> DataFrame:
    """df with SUMIFS over source where its columns equal this row's (keys: df's column -> source's)."""
    value = F.count("*") if target is None else F.sum(target)
    small = source.groupBy(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keys.values())]).agg(value.alias(name))
    on = [F.col(mine) == F.col(f"k_{i}") for i, mine in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return df.join(small, cond, "left").drop(*[f"k_{i}" for i in range(len(keys))]).withColumn(name, F.coalesce(name, F.lit(0)))


def ranges(cells: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """SUM, AVERAGE, MIN and MAX of cells: only numbers count, the first error wins, none gives 0 or #DIV/0!."""
    v = F.col(value)
    num = F.when(v["tag"] == "number", v["num"])
    err = F.min_by(F.when(v["tag"] == "error", v["err"]), F.when(v["tag"] == "error", F.col("pos"))).alias("err_")
    out = cells.groupBy(*by).agg(err, F.coalesce(F.sum(num), F.lit(0.0)).alias("s"), F.count(num).alias("n"), F.min(num).alias("lo"), F.max(num).alias("hi"))
    fine = F.col("err_").isNull()
    return out.select(
        *by, F.when(fine, F.col("s")).alias("sum"), F.when(fine, F.try_divide("s", "n")).alias("average"), F.when(fine, F.coalesce("lo", F.lit(0.0))).alias("min"), F.when(fine, F.coalesce("hi", F.lit(0.0))).alias("max"),
        "err_", F.when(fine & (F.col("n") == 0), "#DIV/0!").otherwise(F.col("err_")).alias("average_err"),
    ).withColumnRenamed("err_", "err")


def column_types(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """cells (by, value, format) -> (by, type, format): text, number, date or mixed, and the most frequent number format,
    of equally frequent ones the last. Counted by format first, so that no list is gathered."""
    from tessera.functions.values import format_kind

    v = F.col("value")
    per = cells.groupBy(*by, "format").agg(F.count_if(v["tag"] == "text").alias("texts"), F.count_if(v["tag"] == "number").alias("numbers"), F.count_if(v["tag"].isin("boolean", "error")).alias("others"))
    best = F.max_by("format", F.struct(F.when(F.col("numbers") > 0, F.col("numbers")).otherwise(-1), F.col("format")))
    out = per.groupBy(*by).agg(F.sum("texts").alias("t"), F.sum("numbers").alias("n"), F.sum("others").alias("o"), best.alias("format"))
    kind = format_kind(F.col("format"))
    shown = F.when(kind == "Date", "date").when(kind == "Text", "text").otherwise("number")
    single = F.when(F.col("t") + F.col("n") + F.col("o") == 0, shown).when((F.col("t") > 0) & (F.col("n") + F.col("o") == 0), "text").when((F.col("n") > 0) & (F.col("t") + F.col("o") == 0), F.when(kind == "Date", "date").otherwise("number"))
    return out.select(*by, F.coalesce(single, F.lit("mixed")).alias("type"), "format")


def census(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both, by each and in all, by one aggregate; where a level is summed over, its column is '*'."""
    sets = df.groupingSets([[a, b], [a], [b], []], a, b).agg(F.grouping(a).alias("ga"), F.grouping(b).alias("gb"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("ga") == 1, "*").otherwise(F.col(a)).alias(a), F.when(F.col("gb") == 1, "*").otherwise(F.col(b)).alias(b), "n")


def common_value(df: DataFrame, by: Sequence[str], value: str, pos: str) -> DataFrame:
    """(by, value, n): the most frequent value, of equals the first to stand, and how often it does."""
    per = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(pos).alias("first_"))
    return per.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first_"))).alias(value), F.max("n").alias("n"))
