"""Streaming queries, run over the files that are there; windows are extensions on the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talus.plans import world as w
from talus.plans.catalog import query
from talus.runtime import TASK_ROWS, new_path, partitions_for, table
from talus.streaming import delivery, state
from talus.streaming import pipelines as st


def _stream(s, d, files=4):
    """The events as a stream of several files."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    p = new_path(s, "events-in")
    e.repartitionByRange(files, "event_id").write.parquet(p)
    return st.file_stream(s, p, e.schema)


@query("st1_file_trigger", "SELECT event_type, count(*) AS n FROM events WHERE value>=50 GROUP BY 1")
def st1(s, d):
    return st.run_to_table(_stream(s, d).where("value >= 50")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("st2_ordered_batches", "SELECT count(*) AS n FROM events")
def st2(s, d):
    return st.run_to_table(_stream(s, d).select("event_id")).agg(F.count("*").alias("n"))


def _delivery(s, d):
    """Events as messages, a group for each user: errors fail at first, and for good unless their number is divisible by three."""
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    p = new_path(s, "queue-in")
    files = max(3, -(-e.count() // TASK_ROWS))
    e.repartitionByRange(files, "event_id").write.parquet(p)
    ok = lambda attempt: (F.col("event_type") != "error") | ((attempt > 1) & (F.col("event_id") % 3 == 0))
    return delivery.Delivery(st.file_stream(s, p, e.schema, files_per_trigger=files), "user_id", "event_id", ok, attempts=2).run()


@query("st2_ordered_delivery", """
SELECT user_id, event_id, CAST(CASE WHEN event_type='error' THEN 2 ELSE 1 END AS INT) AS attempts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS position
FROM events WHERE event_type<>'error' OR event_id%3=0""")
def st2b(s, d):
    """What was delivered, with the place in its group: the order of arrival, whatever was tried again."""
    return _delivery(s, d).table("delivered").select("user_id", "event_id", "attempts", "position")


@query("st2_dead_letters", "SELECT user_id, event_id, CAST(2 AS INT) AS attempts FROM events WHERE event_type='error' AND event_id%3<>0")
def st2c(s, d):
    return _delivery(s, d).table("dead").select("user_id", "event_id", "attempts")


@query("st3_keep_latest", f"WITH {w.EV} SELECT user_id-1 AS user_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC)=1")
def st3(s, d):
    return st.upsert_latest(_stream(s, d), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("st4_ttl", "SELECT event_id FROM events WHERE ts>TIMESTAMP '2024-01-20' ")
def st4(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.within_ttl(e, "ts", F.lit("2024-02-29").cast("timestamp"), 40).select("event_id")


TTL_DAYS = 5


@query("st4_accepted_once", f"""
WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL '1 day' GROUP BY 1, 2),
n AS (SELECT a.user_id, a.ts, b.ts AS next_ts, b.event_id AS next_id FROM e a ASOF LEFT JOIN e b ON a.user_id = b.user_id AND b.ts >= a.ts + INTERVAL '{TTL_DAYS} days'),
r(user_id, ts, event_id) AS (
  SELECT user_id, min(ts), arg_min(event_id, ts) FROM e GROUP BY 1
  UNION ALL SELECT r.user_id, n.next_ts, n.next_id FROM r JOIN n USING(user_id, ts) WHERE n.next_ts IS NOT NULL)
SELECT user_id, event_id FROM r""")
def st4b(s, d):
    """A user's event is taken if none was in the five days before it that was taken: keyed state with a time to live.

    Events of the last day wait for the watermark, which stays a day behind.
    """
    e = table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    p = new_path(s, "ttl-in")
    first, last, rows = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts")), F.count("*")).first()
    part = F.floor((F.unix_micros("ts") - first) * 4 / F.lit(last - first + 1))
    for k in range(4):  # files in the order of time
        e.where(part == k).repartition(1).write.mode("append").parquet(p)
    with state.keyed_state(s, rows):
        out = st.run_to_table(state.once_in_ttl(st.file_stream(s, p, e.schema), "user_id", "ts", "event_id", TTL_DAYS * 86400, "1 day"))
    return out.select(F.col("key").alias("user_id"), F.col("ord").alias("event_id"))


INCIDENTS = """
WITH RECURSIVE a AS (
  SELECT user_id AS incident_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'review' WHEN 'view' THEN 'confirm' ELSE 'dismiss' END AS action,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
  FROM events),
r AS (
  SELECT incident_id, seq, action, n, CASE action WHEN 'review' THEN 'UNDER_REVIEW' WHEN 'dismiss' THEN 'FALSE_POSITIVE' ELSE 'OPEN' END AS state,
    CASE WHEN action IN ('review', 'dismiss') THEN 200 ELSE 409 END AS code
  FROM a WHERE n = 1
  UNION ALL
  SELECT a.incident_id, a.seq, a.action, a.n,
    CASE WHEN r.state = 'OPEN' AND a.action = 'review' THEN 'UNDER_REVIEW' WHEN r.state = 'OPEN' AND a.action = 'dismiss' THEN 'FALSE_POSITIVE'
      WHEN r.state = 'UNDER_REVIEW' AND a.action = 'confirm' THEN 'CONFIRMED' WHEN r.state = 'UNDER_REVIEW' AND a.action = 'dismiss' THEN 'FALSE_POSITIVE' ELSE r.state END,
    CASE WHEN (r.state = 'OPEN' AND a.action IN ('review', 'dismiss')) OR (r.state = 'UNDER_REVIEW' AND a.action IN ('confirm', 'dismiss')) THEN 200 ELSE 409 END
  FROM r JOIN a ON a.incident_id = r.incident_id AND a.n = r.n + 1)
SELECT incident_id, seq, action, state, code FROM r"""


@query("st6_incident_states", INCIDENTS)
def st6(s, d):
    e = table(s, d, "events")
    act = F.when(F.col("event_type") == "click", "review").when(F.col("event_type") == "view", "confirm").otherwise("dismiss")
    a = e.select((F.col("user_id")).alias("incident_id"), F.col("event_id").alias("seq"), act.alias("action"))
    p = new_path(s, "incidents-in")
    a.repartition(3).write.parquet(p)  # several files, taken up by one batch
    return st.run_to_table(st.incident_states(st.file_stream(s, p, a.schema, files_per_trigger=100)))


@query("st6_buffered_incidents", INCIDENTS)
def st6b(s, d):
    """The same states with actions dealt at random over batches: an action waits in the state for those before it."""
    e = table(s, d, "events")
    act = F.when(F.col("event_type") == "click", "review").when(F.col("event_type") == "view", "confirm").otherwise("dismiss")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = e.count()
    a = e.select("user_id", "event_id", act.alias("action")).repartition(partitions_for(s, rows), "user_id")
    a = a.select(F.col("user_id").alias("incident_id"), seq.cast("long").alias("seq"), "action", "event_id")
    p = new_path(s, "incidents-in")
    files = max(1, -(-rows // (3 * TASK_ROWS)))  # of each of the three batches
    a.repartition(3 * files, F.xxhash64("event_id")).write.parquet(p)
    with state.keyed_state(s, rows):
        out = st.run_to_table(state.machine_states(st.file_stream(s, p, a.schema, files_per_trigger=files), ref="event_id"))
    return out.select("incident_id", F.col("event_id").alias("seq"), "action", "state", "code")


@query("st8_stream_metrics", """
WITH b AS (SELECT (event_id*4)//(SELECT max(event_id)+1 FROM events) AS batch, event_type FROM events)
SELECT batch, count(*) AS total, count(*) FILTER (event_type='error') AS failed, round(count(*) FILTER (event_type='error')/count(*),6) AS rate, count(*) FILTER (event_type='error')/count(*)>=0.2 AS alert FROM b GROUP BY 1""")
def st8b(s, d):
    """Rates of a running stream, batch by batch, as a listener saw them."""
    e = table(s, d, "events").select("event_id", "event_type")
    p, out = new_path(s, "metrics-in"), new_path(s, "metrics-out")
    part = F.floor(F.col("event_id") * 4 / F.lit(e.agg(F.max("event_id") + 1).first()[0]))
    for k in range(4):  # a file for each batch, in this order
        e.where(part == k).coalesce(1).write.mode("append").parquet(p)
    start = lambda df: df.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(s, "metrics-checkpoint")).trigger(availableNow=True).start()
    seen = delivery.monitored(st.file_stream(s, p, e.schema), F.col("event_type") == "error", start)
    return seen.withColumn("rate", F.round("rate", 6))


@query("st8_error_alert", "SELECT count(*) AS total, count(*) FILTER (event_type='error') AS failed, round(count(*) FILTER (event_type='error')/count(*),6) AS rate, count(*) FILTER (event_type='error')/count(*)>=0.2 AS alert FROM events")
def st8(s, d):
    return st.error_alert(table(s, d, "events"), F.col("event_type") == "error").withColumn("rate", F.round("rate", 6))


@query("st9_online_store", "SELECT user_id, arg_max(value, struct_pack(a:=ts,b:=event_id)) AS value FROM events GROUP BY 1")
def st9(s, d):
    return st.upsert_latest(_stream(s, d), "user_id", "ts", "event_id").select("user_id", "value")


@query("stx1_tumbling_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1,2")
def stx1(s, d):
    out = st.run_to_table(st.tumbling(_stream(s, d), "ts", "6 hours", "1 day", "event_type"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("stx2_sliding_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) - h*INTERVAL '6 hours' AS window_start, count(*) AS n FROM events, (SELECT unnest([0,1]) AS h) GROUP BY 1")
def stx2(s, d):
    out = st.run_to_table(st.sliding(_stream(s, d), "ts", "12 hours", "6 hours", "1 day"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("stx3_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))<7200000000 THEN 0 ELSE 1 END AS s FROM events), x AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM x GROUP BY user_id, k")
def stx3(s, d):
    out = st.run_to_table(st.sessions(_stream(s, d), "ts", "2 hours", "60 days", "user_id"), "complete")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("st5_checkpointed_restart", "SELECT event_id FROM events")
def st5(s, d):
    """Two runs on one checkpoint: the second takes up where the first ended, and no row comes twice."""
    e = table(s, d, "events").select("event_id")
    src, out, at = (new_path(s, f"st5-{x}") for x in ("in", "out", "checkpoint"))
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).coalesce(2).write.mode("append").parquet(src)
        st.file_stream(s, src, e.schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(e.schema).parquet(out)


@query("st7_pacing", """
SELECT event_id, round(greatest(0.0, 1.1 - coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 1.1)), 6) AS wait,
  round(least(30.0, 2.0 ** (event_id % 7)) * 1.5, 6) AS retry
FROM events""")
def st7(s, d):
    e = table(s, d, "events")
    return st.paced(e, "user_id", "ts", "event_id").select("event_id", F.round("wait", 6).alias("wait"), F.round(st.backoff(F.pmod("event_id", F.lit(7)), share=0.5), 6).alias("retry"))
