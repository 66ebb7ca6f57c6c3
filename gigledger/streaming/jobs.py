"""Streaming forms of the batch operators; each takes and returns streaming DataFrames (and works on batches, too)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.golden import GoldenTable


def rate_counts(attempts: DataFrame, key: str, ts: str = "created_at", window: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Attempts per key in sliding windows, closed once the watermark passes."""
    marked = attempts.withWatermark(ts, late)
    return marked.groupBy(F.window(ts, window, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def first_seen(records: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first record of each key within the watermark; state is dropped with it."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def intake(attempts: DataFrame, ts: str = "created_at", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts per kind of attempt."""
    return attempts.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("was_invalid").alias("invalid")).select("kind", F.col("w.start").alias("window_start"), "n", "invalid")


def sessions(attempts: DataFrame, key: str, ts: str = "created_at", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: runs of attempts with no gap of the given length."""
    return attempts.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


class _Health(StatefulProcessor):
    """Counts of one source; a drop is a run without events after an earlier average above none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "runs long, ok long, candidates long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        runs, ok, candidates = self.state.get() if self.state.exists() else (0, 0, 0)
        for pdf in rows:
            out = []
            for row in pdf.sort_values("crawl_id").itertuples():
                dropped = row.candidates == 0 and runs > 0 and candidates > 0
                runs, ok, candidates = runs + 1, ok + (row.status == "success"), candidates + int(row.candidates)
                out.append((key[0], row.crawl_id, runs, ok, candidates, bool(dropped)))
            yield pd.DataFrame(out, columns=["source_id", "crawl_id", "runs", "ok", "candidates", "dropped"])
        self.state.update((runs, ok, candidates))

    def close(self) -> None:
        pass


def source_health(crawls: DataFrame) -> DataFrame:
    """Running counts of each source per crawl, in the order in which crawls arrive (by crawl_id within a batch).

    Needs the RocksDB state store on a stream.
    """
    return crawls.select("source_id", "crawl_id", "status", "candidates").groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=_Health(), outputStructType="source_id long, crawl_id long, runs long, ok long, candidates long, dropped boolean", outputMode="append", timeMode="none"
    )


def source_health_batch(crawls: DataFrame) -> DataFrame:
    """The same rows by running windows over a whole table."""
    from pyspark.sql import Window

    w = Window.partitionBy("source_id").orderBy("crawl_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return crawls.select(
        "source_id",
        "crawl_id",
        F.count(F.lit(1)).over(w).alias("runs"),
        F.count_if(F.col("status") == "success").over(w).alias("ok"),
        F.sum("candidates").over(w).alias("candidates"),
        ((F.col("candidates") == 0) & (F.coalesce(F.sum("candidates").over(before), F.lit(0)) > 0)).alias("dropped"),
    )


def continuous_upsert(incoming: DataFrame, golden: GoldenTable, order: list[str], checkpoint: str, compact_every: int = 20, least_deltas: int = 4):
    """Merge a stream of candidates into a golden table, one delta per micro-batch; returns the started query.

    A batch reads and writes only the buckets that it touches. Every so many batches the buckets
    that have gathered enough deltas get new base files. A batch that is run again merges into the
    table as it was before it and writes the same delta again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        golden.upsert(batch, batch_id, order)
        if (batch_id + 1) % compact_every == 0:
            golden.compact(batch_id, least_deltas)

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Rows that a watermark would have dropped when they arrive in the given order of `arrival`: older than the newest earlier row less the delay."""
    from pyspark.sql import Window

    newest = F.max(ts).over(Window.partitionBy(F.col("shard")).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_newest", newest).where(F.col(ts) < F.col("_newest") - F.expr(f"interval {late}")).drop("_newest")
