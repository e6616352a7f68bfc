"""Incremental reading, late rows on a second path, sliding windows in several batches, dead letters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postloom.sources.incremental import ChannelFeed
from postloom.streaming import live

ROWS = [("a", i, f"t{i}") for i in range(1, 12)] + [("b", 5, "x"), ("b", 5, "w"), ("b", 5, "w"), (None, 1, "n"), ("c", None, "n"), ("d", 10**12, None)]


def test_feed_takes_every_row_once(spark, tmp_path, monkeypatch):
    source = lambda rows: spark.createDataFrame(rows, "channel string, id long, text string")
    feed = ChannelFeed(spark, f"file://{tmp_path}/feed", per_channel=4)
    assert feed.rows() is None and feed.poll(source([])) == 0
    assert feed.poll(source(ROWS)) == 6  # four of a, one of b (the first by text), one of d
    monkeypatch.setattr(ChannelFeed, "_fs", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        feed.poll(source(ROWS))
    monkeypatch.undo()
    later = ROWS + [("a", 3, "late: below the mark"), ("b", 6, "y"), ("e", 1, "z")]
    ns = []
    while n := feed.poll(source(later)):
        ns.append(n)
    assert ns == [6, 3] and feed.poll(source(later)) == 0
    got = sorted((x["channel"], x["id"], x["text"]) for x in feed.rows().collect())
    assert got == sorted([*ROWS[:11], ("b", 5, "w"), ("b", 6, "y"), ("d", 10**12, None), ("e", 1, "z")], key=lambda x: x[:2])
    assert {x["channel"]: x["last_id"] for x in feed.marks().collect()} == {"a": 11, "b": 6, "d": 10**12, "e": 1}


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


@pytest.mark.parametrize("order", ["in time", "backwards", "shuffled"])
def test_any_arrival_gives_one_table(spark, tmp_path, order):
    """Rows arrive in three batches; those behind six hours take the late path, and the merged table is always the same."""
    rows = [(i, at(i), f"v{i}") for i in range(30)] + [(4, at(3), "earlier, of the same key"), (7, None, "no time"), (7, at(90), "later")]
    rows = {"in time": rows, "backwards": rows[::-1], "shuffled": random.Random(1).sample(rows, len(rows))}[order]
    schema = "id long, ts timestamp, v string"
    for k in range(3):
        spark.createDataFrame(rows[11 * k : 11 * k + 11], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.two_paths(live.incoming(spark, f"{tmp_path}/in", schema), "ts", "6 hours", f"file://{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {x["id"]: x["v"] for x in live.merged(spark, schema, f"file://{tmp_path}/out", ["id"], "ts").collect()}
    first = min(rows, key=lambda r: (r[0] != 7, r[1] is not None))
    assert first[2] == "no time" and got == {i: f"v{i}" for i in range(30)} | {4: "earlier, of the same key", 7: "no time"}
    late = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out/late").count()
    assert (late == 0) == (order == "in time") or order == "in time"


def test_sliding_windows_over_batches(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("xy"), at(r.random() * 96)) for _ in range(200)]
    arrival = sorted(rows, key=lambda x: x[1] + dt.timedelta(hours=r.random() * 20))  # late by up to 20 hours
    schema = "action string, ts timestamp"
    counts = lambda: live.windowed_counts(live.incoming(spark, f"{tmp_path}/in", schema), "ts", "24 hours", "1 day", "6 hours")
    for part in (arrival[:70], arrival[70:140], arrival[140:], [("end", at(10_000))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.run_available(counts(), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(x["action"], x["start"]): x["n"] for x in spark.read.parquet(f"{tmp_path}/out").where("action <> 'end'").collect()}
    batch = spark.createDataFrame(rows, schema).groupBy(F.window("ts", "1 day", "6 hours").alias("w"), "action").count()
    assert got == {(x["action"], x["w"]["start"]): x["count"] for x in batch.collect()}


def test_bad_records_do_not_stop_a_batch(spark, tmp_path):
    raw = ['{"id": 1, "role": "user"}', None, "", "  ", "{", '{"id": "x", "role": "user"}', '{"id": 2}', '{"id": null, "role": "a", "more": 1}', "[]", '{"id": 3, "role": ""}', '{"id": 1, "role": "user"}']
    spark.createDataFrame([(x,) for x in raw], "raw string").coalesce(1).write.parquet(f"{tmp_path}/in")
    live.isolated(live.incoming(spark, f"{tmp_path}/in", "raw string"), "raw", "id bigint, role string not null", lambda df: df.select("id", "role"), f"file://{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    good = sorted(((x["id"], x["role"]) for x in spark.read.parquet(f"{tmp_path}/out/results").collect()), key=str)
    dead = [(x["raw"], x["problem"]) for x in spark.read.parquet(f"{tmp_path}/out/dead").collect()]
    assert good == [(1, "user"), (1, "user"), (3, ""), (None, "a")]
    assert len(dead) == 7 and dict(dead) == {None: "empty", "": "empty", "  ": "empty", "{": "not json", '{"id": "x", "role": "user"}': "not json", '{"id": 2}': "missing role", "[]": dict(dead)["[]"]}
    assert [(x["good"], x["bad"]) for x in spark.read.parquet(f"{tmp_path}/out/counts").collect()] == [(4, 7)]
