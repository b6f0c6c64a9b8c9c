"""Queries of the event-time operators, here over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuplane.session import table
from docuplane.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def event_tumbling(spark, d):
    return ingest.event_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))


def event_sliding(spark, d):
    return ingest.event_windows(table(spark, d, "events"), width="1 hour", slide="30 minutes").withColumn("total", F.round("total", 4))


def event_sessions(spark, d):
    return ingest.event_sessions(table(spark, d, "events")).select("user_id", "session_start", "n")


QUERIES |= {"event_tumbling": event_tumbling, "event_sliding": event_sliding, "event_sessions": event_sessions}
SQL["event_tumbling"] = "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMPTZ) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
SQL["event_sliding"] = "SELECT CAST(time_bucket(INTERVAL '30 minutes', ts) - to_minutes(30 * k) AS TIMESTAMPTZ) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL"
SQL["event_sessions"] = "SELECT user_id, CAST(min(ts) AS TIMESTAMPTZ) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, g"
