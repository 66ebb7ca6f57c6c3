"""Ranking, look-back and sequence operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the given order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank; Spark prunes each task to k rows per key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def look_back(rows: DataFrame, key: str, ts: str, seconds: int, name: str, condition: Column | None = None) -> DataFrame:
    """Adds how many earlier or simultaneous rows of the key lie within so many seconds; the row itself does not count."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    counted = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    own = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
    return rows.withColumn(name, F.when(F.col(key).isNull(), 0).otherwise(counted.over(w) - own))


def renumber(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Dense positions from 1 within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def yield_drops(runs: DataFrame, key: str, order: str, amount: str) -> DataFrame:
    """Runs that found nothing although the key's earlier runs found something on average."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("prior_average", F.avg(amount).over(w)).where((F.col(amount) == 0) & (F.col("prior_average") > 0))


def next_due(last: Column, frequency: Column, as_of: Column) -> Column:
    """When a source is due: never for manual ones, now if never fetched, else last plus its interval."""
    days = F.when(frequency == "daily", 1).when(frequency == "weekly", 7).when(frequency == "biweekly", 14).when(frequency == "monthly", 30)
    return F.when(frequency == "manual", F.lit(None).cast("timestamp")).when(last.isNull(), as_of).otherwise(last + F.make_dt_interval(F.coalesce(days, F.lit(7))))
