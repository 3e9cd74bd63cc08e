"""Log and session operators over events, as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.stages import table
from lodestone.streaming import streams as L

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("l01_latest_by_content", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def l01(spark, d):
    from lodestone.operators.writes import upsert_documents

    e = events(spark, d).select(F.concat_ws("|", "user_id", "event_type").alias("k"), "user_id", "event_type", "event_id")
    return upsert_documents(e.limit(0), e, "k", "event_id").drop("k")


@query("l03_session_rollup", """WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
    y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events,
    coalesce(arg_min(CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'abandoned' END, ts) FILTER (WHERE event_type IN ('purchase', 'error')), 'in_progress') AS status FROM y GROUP BY user_id, s""")
def l03(spark, d):
    x = L.session_rollup(events(spark, d), "user_id", "ts", late=None, event="event_type", terminal={"purchase": "completed", "error": "abandoned"})
    return x.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("l04_windowed_counts", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def l04(spark, d):
    return L.windowed_counts(events(spark, d), ["event_type"], "ts", late=None).withColumn("start", F.col("start").cast("timestamp_ntz"))


COMPACT = "WITH kept AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 98), old AS (SELECT *, ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS AS old FROM events)"


@query("l05_retention", COMPACT + " SELECT event_id FROM old WHERE NOT old OR user_id IN (SELECT user_id FROM kept)")
def l05(spark, d):
    e = events(spark, d).withColumn("event", F.when(F.col("value") > 98, F.col("event_type")))
    return L.compact(e, "user_id", "ts", "2024-01-31", 7, "purchase")[0].select("event_id")


@query("l05_dropped_sessions", COMPACT + " SELECT user_id, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM old WHERE old AND user_id NOT IN (SELECT user_id FROM kept) GROUP BY 1")
def l05b(spark, d):
    e = events(spark, d).withColumn("event", F.when(F.col("value") > 98, F.col("event_type")))
    x = L.compact(e, "user_id", "ts", "2024-01-31", 7, "purchase")[1]
    return x.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("l06_search_log", "SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 50")
def l06(spark, d):
    e = events(spark, d)
    x = L.search_log({"event": e.select("event_id", "event_type", "ts")}, '"purchase"', "ts", 50, 1_000_000)
    return x.select(F.get_json_object("body", "$.event_id").cast("long").alias("event_id"))
