"""Streams over the events table, run once over what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators.relational import latest
from lodestrata.plans.entities import frame
from lodestrata.sources.scratch import scratch_root
from lodestrata.streaming import lifecycle as L


def _root(s) -> str:
    return f"{scratch_root(s)}-streams"


def _events(s, d):
    """The events as a stream: of the folder's files, or of the one file by its name."""
    path = f"{d}/events.parquet"
    hadoop = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 8)
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def e01(s, d):
    out = L.run_to_table(s, L.decaying(_events(s, d)), _root(s), "update", lambda t: latest(t, "user_id", [F.desc("batch")]))
    return out.select("user_id", F.round("ttl_days", 4).alias("ttl_days"))


def e01_expiry(s, d):
    """What is left of each key at the end of the stream; idle keys have vanished."""
    now = lambda t: latest(t, "user_id", [F.desc("batch"), F.desc("expired")])
    left = L.run_to_table(s, L.fading(_events(s, d), ttl=0.5, more=0.1), _root(s), "update", now)
    end = frame(s, d, "events").agg(F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("end"))
    days = F.when(F.col("expired"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("ttl_days") - (F.col("end") / 1e6 - F.col("last")) / L.DAY))
    return left.crossJoin(F.broadcast(end)).select("user_id", F.round(days, 4).alias("ttl_days"), (days <= 0).alias("expired"))


def e02(s, d):
    return L.run_to_table(s, L.access_counts(_events(s, d)), _root(s)).withColumn("last_accessed", F.col("last_accessed").cast("timestamp_ntz"))


def e04(s, d):
    return L.run_to_table(s, L.timeline(_events(s, d)), _root(s))


def e05(s, d):
    return L.run_to_table(s, L.sessions(_events(s, d)), _root(s)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def e06(s, d):
    keep = lambda t: latest(t, "user_id", [F.desc("ts"), F.desc("event_id")])
    return L.run_to_table(s, L.first_seen(_events(s, d)), _root(s), "append", keep).select("user_id", "event_id")


QUERIES = {"e01_stream_decay": e01, "e01_stream_expiry": e01_expiry, "e02_stream_access_counts": e02, "e04_stream_timeline": e04, "e05_stream_sessions": e05, "e06_stream_upsert": e06}

ORACLES = {
    "e02_stream_access_counts": "SELECT user_id, count(*) AS access_count, max(ts) AS last_accessed FROM events GROUP BY user_id",
    "e04_stream_timeline": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "e05_stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
      SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, nth""",
    "e06_stream_upsert": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
}
