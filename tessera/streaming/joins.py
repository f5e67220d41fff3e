"""Joins of two streams, late rows, restarts, and state that stays bounded."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.sources.shared import folder
from tessera.streaming.windows import CLOSED, DELAY, drain, events_stream, tumbling

_ONE = "(SELECT event_id, user_id, ts FROM events WHERE event_type = '{}')"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events_stream(spark, sf_dir)
    left = rows.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
    return left, rows.where("event_type = 'purchase'").select(F.col("event_id").alias("buy"), "user_id", "ts")


@query("stream_left_outer_join", f"SELECT a.event_id AS click, b.event_id AS buy FROM {_ONE.format('click')} a LEFT JOIN {_ONE.format('purchase')} b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE WHERE b.event_id IS NOT NULL OR a.ts + INTERVAL 30 MINUTE < {CLOSED}")
def left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a partner come once the watermark says that none can follow."""
    a, b = _sides(spark, sf_dir)
    within = F.expr("u = user_id AND ts >= at AND ts <= at + INTERVAL 30 MINUTE")
    return drain(spark, a.join(b, within, "left")).select("click", "buy")


@query("stream_semi_join", f"SELECT DISTINCT a.event_id AS click FROM {_ONE.format('click')} a JOIN {_ONE.format('purchase')} b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return drain(spark, a.join(b, F.expr("u = user_id AND ts >= at AND ts <= at + INTERVAL 30 MINUTE"), "left_semi")).select("click")


@query("stream_window_rows_join", "SELECT a.event_id AS click, b.event_id AS buy FROM events a JOIN events b ON a.user_id = b.user_id AND date_trunc('hour', a.ts) = date_trunc('hour', b.ts) WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two streams that fall into the same tumbling window; the window's bounds clear the state."""
    a, b = _sides(spark, sf_dir)
    a, b = a.select("click", "u", F.window("at", "1 hour").alias("w")), b.select("buy", "user_id", F.window("ts", "1 hour").alias("v"))
    return drain(spark, a.join(b, F.expr("u = user_id AND w = v"))).select("click", "buy")


@query("stream_keep_last", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key: one row of state a key."""
    last = events_stream(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("last"))
    return drain(spark, last, "complete").select("user_id", "last.event_id", "last.value")


@query("stream_deduplicate_within", "SELECT DISTINCT event_id FROM events")
def deduplicate_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of an id that arrive within the watermark's delay go; its state is cleared after it."""
    rows = events_stream(spark, sf_dir).select("event_id", "ts")
    return drain(spark, rows.unionAll(rows).dropDuplicatesWithinWatermark(["event_id"])).select("event_id")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events from the middle of their time on (from a full hour), and those before."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = rows.agg(F.date_trunc("hour", F.timestamp_micros(((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2).cast("long")))).first()[0]
    return rows.where(F.col("ts") >= middle), rows.where(F.col("ts") < middle)


def _follow(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", DELAY)


@query("stream_late_rows", "SELECT date_trunc('hour', ts) AS s, count(*) AS n FROM events WHERE ts >= (SELECT date_trunc('hour', min(ts) + (max(ts) - min(ts)) / 2) FROM events) GROUP BY 1 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 4 SECOND FROM events)")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half arrives two batches after the newer one began to move the watermark past it, and is dropped."""
    path, (newer, older) = folder(spark), _halves(spark, sf_dir)
    for part in (newer.where("event_id % 2 = 0"), newer.where("event_id % 2 = 1"), older):
        part.coalesce(1).write.mode("append").parquet(path)
    counts = tumbling(_follow(spark, path, newer.schema), "ts", "1 hour", [], [F.count("*").alias("n")])
    return drain(spark, counts).select(F.col("window.start").cast("timestamp_ntz").alias("s"), "n")


@query("stream_restart", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that ends after half of its input and goes on from its checkpoint: state and offsets are kept, nothing counts twice."""
    path, halves = folder(spark), _halves(spark, sf_dir)
    for part in halves:
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        totals = _follow(spark, f"{path}/in", part.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
        sink = totals.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        sink.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).start().awaitTermination()
    return spark.read.schema("event_type string, n long, ids long").parquet(f"{path}/out")


def top_by_key(stream: DataFrame, key: str, value: str, row: str, k: int) -> DataFrame:
    """The ``k`` rows of each key with the largest ``value`` (ties to the smaller ``row``): state holds k pairs a key, whatever comes."""

    def update(name, frames, state):
        best = json.loads(state.get[0]) if state.exists else []
        for f in frames:
            f = f.sort_values([value, row], ascending=[False, True]).head(k)
            best = sorted([*best, *zip((-f[value]).tolist(), f[row].tolist(), strict=True)], key=tuple)[:k]
        state.update((json.dumps(best),))
        yield pd.DataFrame({key: [name[0]], "rows": [json.dumps([r for _, r in best])]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} string, rows string", "best string", "update", "NoTimeout")


@query("stream_bounded_top_n", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) t WHERE r <= 10")
def bounded_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_by_key(events_stream(spark, sf_dir).select("event_type", "value", "event_id"), "event_type", "value", "event_id", 10)
    return drain(spark, best, "update").select("event_type", F.explode(F.from_json("rows", "array<long>")).alias("event_id"))
