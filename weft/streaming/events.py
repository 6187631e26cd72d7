"""Streams of events and graph changes. The same functions take a batch DataFrame, which gives the results to hold a stream against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that are or come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _late(rows: DataFrame, time: str, late: str | None) -> DataFrame:
    return rows.withWatermark(time, late) if late and rows.isStreaming else rows


def tumbling(rows: DataFrame, window: str, by: list[str], time: str = "ts", value: str = "value", late: str | None = "1 hour") -> DataFrame:
    """(start, by, n, total) of each window; rows later than `late` are left out of a stream."""
    grouped = _late(rows, time, late).groupBy(F.window(time, window).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding_rate(rows: DataFrame, window: str, slide: str, event: Column, time: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """(start, n, rate): the share of rows that are such events in each sliding window."""
    grouped = _late(rows, time, late).groupBy(F.window(time, window, slide).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.avg(event.cast("int")).alias("rate")).select(F.col("w.start").alias("start"), "n", "rate")


def sessions(rows: DataFrame, gap: str, by: list[str], time: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """(by, start, end, n) of runs of rows not farther apart than the gap."""
    grouped = _late(rows, time, late).groupBy(*by, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def trend(rows: DataFrame, window: str, by: list[str], time: str = "ts", value: str = "value") -> DataFrame:
    """(start, by, slope): change of the value an hour within each window."""
    hours = F.unix_micros(F.col(time).cast("timestamp")) / 3.6e9
    return rows.groupBy(F.window(time, window).alias("w"), *by).agg(F.regr_slope(F.col(value), hours).alias("slope"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n", "slope")


def live_matches(stream_rows: DataFrame, nodes: DataFrame, on: str, where: Column) -> DataFrame:
    """Rows of a stream that meet a filter, with the node that they belong to: a pattern as it comes in."""
    return stream_rows.filter(where).join(nodes, on)


def running_state(rows: DataFrame, key: str, key_type: str, value: str = "value") -> DataFrame:
    """(key, n, total) of each key as it changes, kept as state by the stream."""

    def step(k, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, n long, total double", "n long, total double", "update", "NoTimeout")


def apply_changes(changes: DataFrame, target: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """A change feed into a table of snapshots, one a batch, under target/batch=N: a batch that is run again writes the same."""
    spark = changes.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        path = f"{target}/batch={number}"
        if number == 0:
            merge(batch.limit(0).drop("op"), batch).write.mode("overwrite").parquet(path)
        else:
            merge(spark.read.parquet(f"{target}/batch={number - 1}"), batch).write.mode("overwrite").parquet(path)

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there of a stream, in a table in memory: for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def change_events(before: DataFrame, after: DataFrame, key: str, kind: str = "node") -> DataFrame:
    """(key, event): what has been created, updated or deleted from one state to the next."""
    rest = [c for c in before.columns if c != key]
    side = lambda df, name: df.select(key, F.struct(*rest).alias(name))
    met = side(before, "a").join(side(after, "z"), key, "full_outer")
    event = F.when(F.col("a").isNull(), "created").when(F.col("z").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("z")), "updated")
    return met.select(key, F.concat(F.lit(f"{kind}_"), event).alias("event")).filter("event is not null")


def micro_batches(rows: DataFrame, by: str, time: str, tie: str, size: int, seconds: float) -> DataFrame:
    """(by, tie, batch): rows of a buffer by key, in order of time; a batch ends when it is full, or so long after its first row."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    each = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(t.alias("t"), F.col(tie).alias("i")))).alias("all"))
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).cast("long").alias("first"), F.lit(size).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        fresh = (s["n"] >= size) | (x["t"] - s["first"] >= int(seconds * 1_000_000))
        batch = F.when(fresh, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(batch.alias("batch"), F.when(fresh, x["t"]).otherwise(s["first"]).alias("first"), F.when(fresh, F.lit(1)).otherwise(s["n"] + 1).alias("n"), F.array_append(s["out"], batch).alias("out"))

    numbered = F.aggregate("all", start, step)["out"]
    return each.select(by, F.explode(F.arrays_zip(F.col("all.i").alias("i"), numbered.alias("batch"))).alias("z")).select(by, F.col("z.i").alias(tie), F.col("z.batch").alias("batch"))


def each_batch(rows: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands a stream's rows over batch by batch; a batch that is run again has the same number."""
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
