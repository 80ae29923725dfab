"""Quantiles of any range of days from one mergeable sketch a day and key, without the raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a sketch: the rank of a quantile is off by about 2 / K of all rows at most (99 % of the time), merged or not.
K = 800


def day_sketches(rows: DataFrame, by: list[str], time: str, value: str, k: int = K) -> DataFrame:
    """(day, by.., n, least, most, sketch): values that are not null by day and key; one partial aggregate of bounded size."""
    v = F.col(value).cast("double")
    some = rows.where(F.col(value).isNotNull()).groupBy(F.to_date(time).alias("day"), *by)
    return some.agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def store_days(sketches: DataFrame, path: str) -> None:
    """Write the sketches by day; days that are there already are replaced, others stay as they are."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quantiles(sketches: DataFrame, by: list[str], ranks: dict[str, float], start: str | None = None, end: str | None = None, k: int = K) -> DataFrame:
    """by.., n, least, most and the quantile of each name over the days from start to end (both included, null: all)."""
    days = sketches
    for limit, side in ((start, ">="), (end, "<=")):
        days = days if limit is None else days.where(f"day {side} date '{limit}'")
    merged = days.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("s"))
    return merged.select(*by, "n", "least", "most", *[F.kll_sketch_get_quantile_double("s", F.lit(r)).alias(name) for name, r in ranks.items()])
