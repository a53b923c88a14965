"""Event streams: time buckets, late data, and the state of a job folded from its events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def parse_props(props: Column) -> Column:
    """WF-08: the JSON object, or null for a poison message."""
    return F.from_json(props, "k bigint")


def hourly_percentile(events: DataFrame, percent: float = 0.95) -> DataFrame:
    """AGG-19: nearest-rank percentile, mean, sum and count per hour and type."""
    hour = F.date_trunc("hour", "ts")
    p = F.expr(f"percentile_disc({percent}) WITHIN GROUP (ORDER BY value)")
    return events.groupBy(hour.alias("hour"), "event_type").agg(p.alias("p"), F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("*").alias("n"))


def breach_hours(events: DataFrame, limit: float, percent: float = 0.95) -> DataFrame:
    """AGG-20: hours of each type whose percentile is over the limit."""
    return hourly_percentile(events, percent).groupBy("event_type").agg(F.count("*").alias("hours"), F.count_if(F.col("p") > limit).alias("breaches"))


def filled_traffic(events: DataFrame, step: str = "1 hour") -> DataFrame:
    """WF-10: events per bucket and type, empty buckets between the first and the last included as 0."""
    bounds = events.agg(F.date_trunc("hour", F.min("ts")).alias("lo"), F.date_trunc("hour", F.max("ts")).alias("hi"), F.collect_set("event_type").alias("types"))
    grid = bounds.select(F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias("bucket"), "types")
    full = grid.select("bucket", F.explode("types").alias("event_type"))
    n = events.groupBy(F.window("ts", step).start.alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    return full.join(n, ["bucket", "event_type"], "left").na.fill(0, ["n"])


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user, cut at pauses of ``gap``."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("w.start").alias("start"), "n", "total")


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and type with a watermark; works on a stream and on a table."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).parquet(folder)


def latest_state(events: DataFrame) -> DataFrame:
    """WF-05 as a batch fold: last event type, number of events and highest value of each user."""
    order = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", order).alias("last_type"), F.count("*").alias("n"), F.max("value").alias("top"))


def fold_state(stream: DataFrame) -> DataFrame:
    """WF-05 as a stream: the same fold with state per user, giving a row whenever a user has new events."""

    def step(key: tuple, batches, state: GroupState):
        n, top, last, when, event = state.get if state.exists else (0, float("-inf"), "", 0, -1)
        for pdf in batches:
            n += len(pdf)
            top = max(top, pdf["value"].max())
            order = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            at = (order["ts"].value, int(order["event_id"]))
            if at > (when, event):
                (when, event), last = at, order["event_type"]
        state.update((n, top, last, when, event))
        yield pd.DataFrame([(key[0], last, n, top)], columns=["user_id", "last_type", "n", "top"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, last_type string, n bigint, top double", "n bigint, top double, last string, at bigint, event bigint", "update", "NoTimeout")
