"""Event-time operators on Structured Streaming.

Each builder takes a streaming (or batch) DataFrame and returns one; ``drain`` runs a
stream over what its source holds now, into files in the shared folder, and reads them.
Windows, sessions and interval joins are cleared by the watermark; aggregates without
a window keep one row a key (deduplication by key, a row of each pair seen).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.sources.shared import folder

DELAY = "4 seconds"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with a watermark. Their timestamps lack a zone, which a watermark rejects; they are taken as UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs until the source is exhausted. Append mode goes straight to files; update and complete mode keep the last version of each batch."""
    path = folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.outputMode("append").format("parquet").option("path", f"{path}/out").start()
    else:
        q = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def tumbling(stream: DataFrame, at: str, size: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    return stream.groupBy(F.window(at, size), *keys).agg(*aggregates)


def hopping(stream: DataFrame, at: str, size: str, slide: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    return stream.groupBy(F.window(at, size, slide), *keys).agg(*aggregates)


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    return stream.groupBy(F.session_window(at, gap), *keys).agg(*aggregates)


def first_by_key(stream: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The first row of each key, with state that the watermark clears."""
    return stream.dropDuplicatesWithinWatermark(keys) if at not in keys else stream.dropDuplicates(keys)


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_at: str, right_at: str, within: str) -> DataFrame:
    return left.join(right, on & (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"interval {within}")))


def latest_by_key(stream: DataFrame, key: str, at: str, value: str, value_type: str) -> DataFrame:
    """A custom stateful operator: the latest value of each key, updated as rows come."""

    def update(k, frames, state):
        best = state.get if state.exists else None
        for f in frames:
            f = f.sort_values([at, value])
            row = f.iloc[-1]
            new = (int(row[at].value // 1000), float(row[value]))
            best = new if best is None or new >= tuple(best) else best
        state.update(tuple(best))
        yield pd.DataFrame({key: [k[0]], value: [best[1]]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} long, {value} {value_type}", "at long, v double", "update", "NoTimeout")


def _span(w: str) -> list[Column]:
    return [F.col(f"{w}.start").cast("timestamp_ntz").alias("s"), F.col(f"{w}.end").cast("timestamp_ntz").alias("e")]


CLOSED = "(SELECT max(ts) - INTERVAL 4 SECOND FROM events)"


@query("stream_calc", "SELECT event_id, value * 2 AS v FROM events WHERE event_type = 'click'")
def calc(spark, sf_dir):
    return drain(spark, events_stream(spark, sf_dir).where("event_type = 'click'").select("event_id", (F.col("value") * 2).alias("v")))


@query("stream_tumble", f"SELECT s, s + INTERVAL 1 HOUR AS e, event_type, n FROM (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2) t WHERE s + INTERVAL 1 HOUR <= {CLOSED}")
def tumble(spark, sf_dir):
    return drain(spark, tumbling(events_stream(spark, sf_dir), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")])).select(*_span("window"), "event_type", "n")


@query("stream_hop", f"SELECT s, s + INTERVAL 2 HOUR AS e, n FROM (SELECT date_trunc('hour', ts) - INTERVAL (k) HOUR AS s, count(*) AS n FROM events, range(2) r(k) GROUP BY 1) t WHERE s + INTERVAL 2 HOUR <= {CLOSED}")
def hop(spark, sf_dir):
    return drain(spark, hopping(events_stream(spark, sf_dir), "ts", "2 hours", "1 hour", [], [F.count("*").alias("n")])).select(*_span("window"), "n")


@query("stream_session", f"SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events) a) b GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}")
def session(spark, sf_dir):
    return drain(spark, sessions(events_stream(spark, sf_dir), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])).select("user_id", *_span("session_window"), "n")


@query("stream_group_aggregate", "SELECT event_type, count(*) AS n, max(event_id) AS m FROM events GROUP BY 1")
def group_aggregate(spark, sf_dir):
    return drain(spark, events_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("m")), "complete")


@query("stream_filtered_aggregate", "SELECT user_id, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY 1")
def filtered_aggregate(spark, sf_dir):
    return drain(spark, events_stream(spark, sf_dir).groupBy("user_id").agg(F.count(F.when(F.col("value") > 50, 1)).alias("high")), "complete")


@query("stream_deduplicate", "SELECT DISTINCT user_id, event_type FROM events")
def deduplicate(spark, sf_dir):
    stream = events_stream(spark, sf_dir).select("user_id", "event_type", "ts")
    return drain(spark, stream.dropDuplicates(["user_id", "event_type"])).select("user_id", "event_type")


@query("stream_interval_join", "SELECT a.event_id AS click, b.event_id AS buy FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def joined_intervals(spark, sf_dir):
    a = events_stream(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
    b = events_stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("buy"), "user_id", "ts")
    return drain(spark, interval_join(a, b, F.col("u") == F.col("user_id"), "at", "ts", "30 minutes")).select("click", "buy")


@query("stream_window_pair_aggregate", f"SELECT s, a.user_id, a.n AS clicks, b.n AS buys FROM (SELECT date_trunc('hour', ts) AS s, user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2) a JOIN (SELECT date_trunc('hour', ts) AS s, user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b USING (s, user_id) WHERE s + INTERVAL 1 HOUR <= {CLOSED}")
def window_join(spark, sf_dir):
    """Two window aggregates side by side, as one conditional aggregate instead of a join."""
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    both = tumbling(events_stream(spark, sf_dir), "ts", "1 hour", ["user_id"], [n("click").alias("clicks"), n("purchase").alias("buys")])
    return drain(spark, both.where("clicks > 0 and buys > 0")).select(F.col("window.start").cast("timestamp_ntz").alias("s"), "user_id", "clicks", "buys")


@query("stream_static_join", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def stream_static(spark, sf_dir):
    return drain(spark, events_stream(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@query("stream_latest_state", "SELECT user_id, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1")
def latest(spark, sf_dir):
    return drain(spark, latest_by_key(events_stream(spark, sf_dir).select("user_id", "ts", "value"), "user_id", "ts", "value", "double"), "update")


@query("stream_top_n", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) t WHERE r <= 10")
def top_n(spark, sf_dir):
    """Top 10 of each key from all its rows, which are kept as state; ``stream_bounded_top_n`` keeps ten."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), "event_id"))), 1, 10)
    stream = events_stream(spark, sf_dir).groupBy("event_type").agg(best.alias("best"))
    return drain(spark, stream, "complete").select("event_type", F.explode("best.event_id").alias("event_id"))


@query("stream_global_count", "SELECT count(*) AS n FROM events")
def memory_of_counts(spark, sf_dir):
    return drain(spark, events_stream(spark, sf_dir).agg(F.count("*").alias("n")), "complete")
