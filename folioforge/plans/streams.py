"""Queries over time limits and cancel requests; the functions are those of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.streaming import limits

from .common import table


def _lifecycles(spark: SparkSession, d: str) -> DataFrame:
    """A user's day as an analysis of 24 minutes."""
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", ts)
    quick = F.timestamp_micros(F.unix_micros(day) + F.floor((F.unix_micros(ts) - F.unix_micros(day)) / 60))
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "cancelled").otherwise("analyzing")
    key = F.concat_ws("-", "user_id", F.date_format(ts, "yyyy-MM-dd"))
    return e.select(key.alias("key"), quick.alias("ts"), F.col("event_id").alias("event_no"), status.alias("status"), F.floor("value").cast("int").alias("progress"), (F.floor("value") * 5).cast("int").alias("pages"))


def ended_analyses(spark: SparkSession, d: str) -> DataFrame:
    out = limits.ended(_lifecycles(spark, d))
    return out.select("key", F.unix_micros("ended_at").alias("ended_us"), "status", "progress", "n_events")


ENDED_ANALYSES = """
WITH e AS (
  SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS key, event_id, event_type,
         epoch_us(date_trunc('day', ts)) + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 60 AS us,
         CAST(floor(value) AS INT) AS progress, CAST(floor(value) * 5 AS INT) AS pages FROM events),
f AS (SELECT *, first_value(us) OVER w + 60000000 * first_value(CASE WHEN pages <= 50 THEN 8 WHEN pages <= 100 THEN 12 WHEN pages <= 200 THEN 18 ELSE 25 END) OVER w AS deadline
      FROM e WINDOW w AS (PARTITION BY key ORDER BY us, event_id)),
i AS (SELECT *, coalesce(max(CAST(event_type IN ('purchase', 'error') AS INT)) OVER (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_
      FROM f WHERE us <= deadline),
g AS (SELECT key, any_value(deadline) AS deadline, max(us) AS last_us, arg_max(event_type, (us, event_id)) AS last_type, max(progress) AS most, count(*) AS n FROM i WHERE over_ = 0 GROUP BY key),
o AS (SELECT key, last_type IN ('purchase', 'error') AS done, CASE WHEN last_type IN ('purchase', 'error') THEN last_us ELSE deadline END AS ended_us, last_type, most, n FROM g)
SELECT key, ended_us, CASE WHEN NOT done THEN 'error' WHEN last_type = 'purchase' THEN 'completed' ELSE 'cancelled' END AS status,
       CAST(least(CASE WHEN done THEN 100 ELSE 95 END, most) AS INT) AS progress, n AS n_events
FROM o WHERE ended_us <= (SELECT max(us) FROM e)
"""


def cancelled_runs(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups as runs, errors of the same user as cancel requests within twelve hours."""
    e = table(spark, d, "events")
    runs = e.where("event_type = 'signup'").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("key"), F.col("ts").alias("started_at"))
    cancels = e.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("ts").alias("requested_at"))
    out = limits.with_cancels(runs, cancels, "12 hours")
    return out.groupBy("run_id", "key").agg(F.count("requested_at").alias("n_requests"), F.unix_micros(F.min("requested_at")).alias("first_us"))


CANCELLED_RUNS = """
SELECT r.event_id AS run_id, r.user_id AS key, count(c.ts) AS n_requests, epoch_us(min(c.ts)) AS first_us
FROM events r LEFT JOIN events c ON c.user_id = r.user_id AND c.event_type = 'error' AND c.ts >= r.ts AND c.ts <= r.ts + INTERVAL 12 HOUR
WHERE r.event_type = 'signup' GROUP BY r.event_id, r.user_id
"""

QUERIES = {"ended_analyses": (ended_analyses, ENDED_ANALYSES), "cancelled_runs": (cancelled_runs, CANCELLED_RUNS)}
