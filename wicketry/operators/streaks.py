"""Unbroken runs of rows that pass a test, rolled up by segments that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(df: DataFrame, keys: list[str], hit: Column, order: list[str], sums: tuple[str, ...] = (), most: tuple[str, ...] = ()) -> DataFrame:
    """One row per run: keys, length, start_date, end_date, sums and maxima of columns. ``order`` begins with date_start; a null test is a miss.

    No window holds the whole history of a key. Runs are found inside a key's calendar year (undated rows are a segment of
    their own, the first) and rolled up there. Only a segment's first and last run can go on in another one, so at
    most two rows a year meet again by key and are joined across the borders, misses among them, as they part their neighbours. All
    other runs are final and spread by their own number.
    """
    x = df.withColumns({"hit": F.coalesce(hit, F.lit(False)), "_year": F.year("date_start")})
    segment = Window.partitionBy(*keys, "_year")
    x = x.withColumns({"_at": F.row_number().over(segment.orderBy(*order)), "_n": F.count("*").over(segment), "_same": F.row_number().over(Window.partitionBy(*keys, "_year", "hit").orderBy(*order))})
    x = x.withColumn("_run", F.col("_at") - F.col("_same"))
    runs = x.groupBy(*keys, "_year", "hit", "_run").agg(
        F.count("*").alias("length"), F.min("date_start").alias("start_date"), F.max("date_start").alias("end_date"), *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in most),
        F.min("_at").alias("_first"), (F.max("_at") == F.max("_n")).alias("_closes"))
    edge = (F.col("_first") == 1) | F.col("_closes")
    runs = runs.filter(F.col("hit") | edge).withColumn("_slot", F.when(~edge, F.struct("_year", "_run")))
    across = Window.partitionBy(*keys, "_slot").orderBy("_year", "_first")
    goes_on = (F.lag("hit").over(across) == F.col("hit")) & ~F.lag("_year").over(across).eqNullSafe(F.col("_year"))
    runs = runs.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_id", F.sum("_new").over(across))
    whole = runs.filter("hit").groupBy(*keys, "_slot", "_id").agg(
        F.sum("length").alias("length"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in most))
    return whole.drop("_slot", "_id")
