"""Structured Streaming jobs over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import features, models
from tabsmith.streaming import quality
from tabsmith.session import materialize
from workload.base import query
from workload.preparation import rounded


def stream_events(t):
    return quality.read_files(t.spark, t.folder, "events.parquet", t.events.schema)


def fixed_limits(t):
    """The limits of the batch table, computed once and not again in every micro-batch."""
    return materialize(quality.limits(t.events, "event_type", "value"), "limits")


LIMITS = "(SELECT event_type, avg(value) AS m, avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM events GROUP BY event_type)"


@query(
    "stream_quality_ledger",
    f"""SELECT event_id, e.event_type, value, round(value - m, 4) AS deviation, value < lo OR value > hi AS out_of_limits FROM events e JOIN {LIMITS} l ON e.event_type = l.event_type
      ORDER BY ts DESC, event_id LIMIT 50""",
)
def stream_quality_ledger(t):
    rows = quality.ledger(stream_events(t), fixed_limits(t), "event_type", "value")
    done = quality.run_to_end(rows, "append")
    newest = done.orderBy(F.desc("ts"), "event_id").limit(50)
    return rounded(newest.select("event_id", "event_type", "value", "deviation", "out_of_limits"), 4, "deviation")


@query(
    "stream_quality_counts",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, e.event_type, count(*) AS n, count(*) FILTER (WHERE value < lo OR value > hi) AS out
      FROM events e JOIN {LIMITS} l ON e.event_type = l.event_type GROUP BY 1, 2""",
)
def stream_quality_counts(t):
    src = stream_events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = quality.ledger(src, fixed_limits(t), "event_type", "value")
    done = quality.run_to_end(quality.ledger_counts(rows, "ts", "event_type", "1 day", "1 hour"), "update")
    out = quality.newest(done, ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "out")


@query(
    "stream_capability",
    """WITH w AS (SELECT event_type, value, date_trunc('day', ts) - CAST(k AS INTEGER) * INTERVAL 1 DAY AS start FROM events, range(0, 2) r(k))
      SELECT strftime(start, '%Y-%m-%d') AS day, event_type, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd,
      round(least(160 - avg(value), avg(value) + 40) / (3 * stddev_samp(value)), 9) AS ppk FROM w GROUP BY start, event_type""",
)
def stream_capability(t):
    src = stream_events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    cap = quality.windowed_capability(src, "ts", "event_type", "value", -40.0, 160.0, "2 days", "1 day", "1 hour")
    out = quality.newest(quality.run_to_end(cap, "update"), ["start", "event_type"])
    return rounded(
        out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean", "sd", "ppk"), 9, "mean", "sd", "ppk"
    )


@query("stream_score")
def stream_score(t):
    from pyspark.ml import Pipeline

    def ready(df):
        return features.prepare(df.withColumn("label", F.col("value")).withColumn("hour", F.hour("ts").cast("double")), ["hour"], ["event_type"])

    stages = [*features.feature_stages(["hour"], ["event_type"], scale="standard"), models.ridge(t.events.count(), 1.0)]
    model = Pipeline(stages=stages).fit(ready(t.events))
    scored = quality.score(ready(stream_events(t)), model).select("event_id", "prediction")
    return quality.run_to_end(scored, "append").drop("_batch")


@query(
    "stream_moving_range",
    """SELECT event_type AS key, event_id AS id, value, round(mr, 6) AS mr FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS mr FROM events)
      WHERE date_trunc('milliseconds', ts) <= (SELECT max(date_trunc('milliseconds', ts)) - INTERVAL 10 MINUTE FROM events)""",
)
def stream_moving_range(t):
    """Rows younger than the final watermark stay pending, as on a live stream."""
    mr = quality.moving_range(stream_events(t), "event_type", "ts", "event_id", "value", "10 minutes")
    done = quality.run_to_end(mr, "append")
    return rounded(done.select("key", "id", "value", "mr"), 6, "mr")
