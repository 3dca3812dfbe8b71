"""Streaming decay with timers against a walk over the events."""

import datetime as dt
import time

from lodestrata.plans.streaming_queries import e01_expiry
from lodestrata.streaming import lifecycle as L


def walk(rows, ttl, more):
    """user: what is left after the last access, and that access, in seconds."""
    out = {}
    for user, ts in sorted(rows, key=lambda r: r[1]):
        left, last = out.get(user, (ttl, None))
        left -= (ts - last) / L.DAY if last is not None else 0
        out[user] = ((left if left > 0 else ttl) + more, ts)
    return out


def test_expiry_equals_a_walk(spark, small):
    events = [(r.user_id, r.s) for r in spark.read.parquet(f"{small}/events.parquet").selectExpr("user_id", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS s").collect()]
    end = max(s for _, s in events)
    want = {u: max(0.0, left - (end - last) / L.DAY) for u, (left, last) in walk(events, 0.5, 0.1).items()}
    got = {r.user_id: (r.ttl_days, r.expired) for r in e01_expiry(spark, small).collect()}
    assert got.keys() == want.keys() and all(abs(got[u][0] - round(want[u], 4)) < 2e-4 and got[u][1] == (want[u] <= 0) for u in want)
    assert 0 < sum(x for _, x in got.values()) < len(got)


def test_idle_keys_vanish_by_timer(spark, tmp_path):
    """Four files, one a batch: a key's state goes when the watermark passes its end, without a row of its own."""
    begin, source = dt.datetime(2024, 1, 1), f"file://{tmp_path}/in"
    for rows in ([(1, 0.0), (1, 2.0), (2, 0.0)], [(3, 10.0)], [(1, 11.0), (3, 20.0)], [(3, 30.0)]):
        spark.createDataFrame([(u, begin + dt.timedelta(days=d)) for u, d in rows], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    rows = [(r.user_id, round(r.ttl_days, 6), r.expired) for r in L.run_to_table(spark, L.fading(stream, 3.0, 1.0), f"file://{tmp_path}", "update").collect()]
    assert (1, 3.0, False) in rows and (1, 4.0, False) in rows and (2, 0.0, True) in rows and (1, 0.0, True) in rows
    assert [r for r in rows if r[0] == 3 and not r[2]] == [(3, 4.0, False)] * 3
