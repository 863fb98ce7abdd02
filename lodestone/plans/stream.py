"""Windows and sessions over events; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources.tables import table
from lodestone.streaming import events as streaming


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """[W11]"""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed(e, "ts", "1 day", "2 days", ["event_type"]).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark, d):
    """[W2] Gaps of six hours."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.sessions(e, "ts", "6 hours", "1 day", ["user_id"]).select("user_id", F.unix_seconds("start").alias("start"), "n")
