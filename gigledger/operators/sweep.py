"""Ordered operators over hot keys: running sums, positions and next rows of a sequence that spans tasks.

Rows are dealt by ranges of (keys, order), so a key with half of all rows lies in many ranges.
Every range is worked through alone; what it needs of the ranges before or after it is one row,
as at most one key of a range goes on from the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

PART = "_part"
# rows of one range: what a task sorts does not grow with the table
RANGE = 500_000


def ranged(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows with their range as a column, in a checkpoint, so that every later use sees the same ranges. Rows with equal keys and order lie in one range.

    There are as many ranges, and tasks that work through them, as the rows need at RANGE rows each.
    """
    parts = parts or max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE))
    dealt = rows.repartitionByRange(parts, *[F.col(c) for c in (*keys, *order)])
    return cut(dealt.withColumn(PART, F.spark_partition_id())).repartition(parts, PART, *keys)


def running_sums(dealt: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], ties: bool = False) -> DataFrame:
    """Adds running sums over ranged rows, from the first row of a key to this one; with ties, to the last row of equal order."""
    w = Window.partitionBy(PART, *keys).orderBy(*order)
    w = w.rangeBetween(Window.unboundedPreceding, 0) if ties else w.rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy(PART, *keys).agg(*[F.sum(c).alias(f"_before_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(PART, *keys, F.count(F.lit(1)).over(earlier).alias("_n"), *[F.sum(f"_before_{n}").over(earlier).alias(f"_before_{n}") for n in sums])
    before = before.where("_n > 0").drop("_n")  # at most one row a range
    out = dealt.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    out = _meet(out, before, keys)
    return out.withColumns({n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums}).drop(*[f"_before_{n}" for n in sums])


def with_next(dealt: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds columns of the next row of the key: {new name: column}; null at a key's last row. order must be total within a key."""
    w = Window.partitionBy(PART, *keys).orderBy(*order)
    first = dealt.groupBy(PART, *keys).agg(F.min(F.struct(*order, *[F.col(c).alias(f"_v_{n}") for n, c in columns.items()])).alias("_f"))
    later = Window.partitionBy(*keys).orderBy(PART)
    after = first.select(PART, *keys, *[F.lead(f"_f._v_{n}").over(later).alias(f"_after_{n}") for n in columns], F.lead(F.lit(1)).over(later).alias("_more"))
    after = after.where("_more = 1").drop("_more")  # at most one row a range
    out = dealt.withColumns({n: F.lead(c).over(w) for n, c in columns.items()} | {"_inner": F.lead(F.lit(1)).over(w)})
    out = _meet(out, after, keys)
    return out.withColumns({n: F.when(F.col("_inner") == 1, F.col(n)).otherwise(F.col(f"_after_{n}")) for n in columns}).drop("_inner", *[f"_after_{n}" for n in columns])


def _meet(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with at most one row per range: few enough to broadcast, as there is one range for RANGE rows. Keys may be null."""
    names = {c: f"_k_{c}" for c in (PART, *keys)}
    edges = edges.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return rows.join(F.broadcast(edges), same, "left").drop(*names.values())


@dataclass(frozen=True)
class LookBack:
    """One count per row: rows of the same key within the seconds before it, ties included, itself left out.

    key None means all rows. With a condition only rows that meet it count. With a value the
    count is of distinct other values that the key had.
    """

    name: str
    key: str | None
    seconds: int
    condition: str | None = None
    value: str | None = None


def look_backs(rows: DataFrame, id_col: str, ts: str, measures: list[LookBack]) -> DataFrame:
    """(id, one long per measure) for every row; ids must be unique, rows without a measure's key or without a time count 0.

    Every counted row is a step up at its time and a step down when it leaves the window; a value
    leaves earlier if its key has it again, so that a running sum over the steps is a distinct
    count, too. All measures are swept at once; nothing is gathered, and a key or even all rows
    may span tasks.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    condition = lambda m: F.expr(m.condition) if m.condition else F.lit(True)
    key = lambda m: F.col(m.key).cast("string") if m.key else F.lit("")
    base = rows.select(F.col(id_col).alias("_id"), at.alias("_at"), *[
        F.when(key(m).isNotNull(), F.struct(F.lit(i).alias("m"), key(m).alias("k"), (F.col(m.value).cast("string") if m.value else F.lit(None).cast("string")).alias("v"), F.coalesce(condition(m), F.lit(False)).alias("counts"), F.lit(m.seconds * 1_000_000).cast("long").alias("width"))).alias(f"_m{i}")
        for i, m in enumerate(measures)
    ])
    asked = base.where("_at is not null").select("_id", "_at", F.explode(F.array_compact(F.array(*[f"_m{i}" for i in range(len(measures))]))).alias("x")).select("_id", "_at", "x.*")
    distinct = [i for i, m in enumerate(measures) if m.value]
    n = rows.count()  # of the rows alone: their steps are not made only to be counted
    ranges = lambda each: max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * each // RANGE))
    plain = asked.where(~F.col("m").isin(distinct)) if distinct else asked
    ends = plain.withColumn("_end", F.col("_at") + F.col("width") + 1)
    if distinct:
        valued = ranged(asked.where(F.col("m").isin(distinct)), ["m", "k", "v"], ["_at", "_id"], ranges(len(distinct)))
        valued = with_next(valued, ["m", "k", "v"], ["_at", "_id"], {"_again": "_at"}).drop(PART)
        valued = valued.withColumn("counts", F.col("counts") & F.col("v").isNotNull())
        # in a checkpoint, as ranges are first sampled and then dealt: the next rows are found once
        ends = ends.unionByName(cut(valued.withColumn("_end", F.least(F.col("_at") + F.col("width") + 1, F.coalesce("_again", F.lit(2**63 - 1)))).drop("_again")))
    up = F.struct(F.col("_at").alias("at"), F.col("counts").cast("long").alias("step"), F.col("_id").alias("id"), F.lit(True).alias("asks"))
    down = F.struct(F.col("_end").alias("at"), F.lit(-1).cast("long").alias("step"), F.col("_id").alias("id"), F.lit(False).alias("asks"))
    steps = ends.select("m", "k", "counts", F.explode(F.when(F.col("counts"), F.array(up, down)).otherwise(F.array(up))).alias("s")).select("m", "k", "counts", "s.*")
    swept = running_sums(ranged(steps, ["m", "k"], ["at"], ranges(2 * len(measures))), ["m", "k"], ["at"], {"n": F.col("step")}, ties=True).where("asks")
    own = F.col("n") - F.col("counts").cast("long")
    found = swept.groupBy(F.col("id").alias("_id")).agg(*[F.max(F.when(F.col("m") == i, own)).alias(m.name) for i, m in enumerate(measures)])
    out = rows.select(F.col(id_col)).join(found, F.col(id_col) == F.col("_id"), "left")
    return out.select(id_col, *[F.coalesce(m.name, F.lit(0)).cast("long").alias(m.name) for m in measures])
