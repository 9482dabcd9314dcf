"""Streams that are stopped and started again give what one batch gives."""

import datetime as dt
import random

from docforge.sources.sinks import append_batch
from docforge.streaming import events as E

SCHEMA = "chunk_id bigint, status string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def history(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice([*range(30), None]), rng.choice(["PROCESSING", "PROCESSING", "COMPLETED", None]), START + dt.timedelta(minutes=i + rng.random() / 2)) for i in range(n)]
    return rows


def feed(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_appends_happen_once(spark, tmp_path):
    rows, log, seen = history(1), str(tmp_path / "log"), str(tmp_path / "checkpoint")
    for k in range(4):
        feed(spark, tmp_path / "in", rows[k * 100 : k * 100 + 100], f"part={k}")
        E.append_stream(E.event_stream(spark, f"{tmp_path}/in/*", SCHEMA, 1), log, seen).awaitTermination()
    got = spark.read.parquet(log)
    append_batch(got.where("batch = 2").drop("batch").coalesce(1), f"{tmp_path}/copy", 2)
    append_batch(got.where("batch = 2").drop("batch").coalesce(1), f"{tmp_path}/copy", 2)
    assert sorted(map(repr, got.drop("batch").collect())) == sorted(map(repr, spark.createDataFrame(rows, SCHEMA).collect()))
    assert spark.read.parquet(f"{tmp_path}/copy").count() == got.where("batch = 2").count() > 0


def test_stale_work_is_failed_alike_by_a_restarted_stream(spark, tmp_path):
    rows = history(2) + [(99, "PROCESSING", START + dt.timedelta(minutes=3)), (98, "COMPLETED", START + dt.timedelta(minutes=3))]
    rows.sort(key=lambda r: r[2])
    end = START + dt.timedelta(days=1)
    seen, log = str(tmp_path / "checkpoint"), str(tmp_path / "log")
    parts = [rows[:150], rows[150:], [(1000, "COMPLETED", end)], [(1001, "COMPLETED", end)]]
    for k, part in enumerate(parts):  # each turn is a restart
        feed(spark, tmp_path / "in", part, f"part={k}")
        E.append_stream(E.stale_work(E.event_stream(spark, f"{tmp_path}/in/*", SCHEMA, 1)), log, seen).awaitTermination()
    got = {(r.chunk_id, r.since) for r in spark.read.parquet(log).collect()}
    last = {(r.chunk_id, r.since) for r in E.stale_chunks(spark.createDataFrame(rows, SCHEMA), end - dt.timedelta(minutes=10)).collect()}
    assert (99, START + dt.timedelta(minutes=3)) in got and last <= got
    at = {}
    for c, s, t in rows:
        at.setdefault(c, []).append((t, s))
    for c, since in got - last:  # failed meanwhile: nothing was heard of it for long enough
        later = [t for t, _ in at[c] if t > since]
        assert (since, "PROCESSING") in at[c] and (not later or min(later) - since > dt.timedelta(minutes=30))
    assert all(r.status == "FAILED" for r in spark.read.parquet(log).collect())
