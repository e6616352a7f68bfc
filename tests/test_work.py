"""Work that must not be done more often than asked: jobs of a block of decisions, rows of a micro-batch, passes over a text."""

import re

import pytest
from pyspark.sql import functions as F

from postloom.checkpoints import keeper
from postloom.functions import expressions as E
from postloom.functions import vocab as V
from postloom.operators import graph as G
from postloom.operators.matching import decided, features
from postloom.plans.catalogue import queries
from postloom.streaming import live


def test_jobs_of_a_block(spark):
    """A block of decisions takes a few jobs, however many blocks came before it; the decisions are one table."""
    rows = [(i, f"story {i % 7} of words w{i % 5} x{i % 11} y{i % 13} told by some", i) for i in range(120)]
    keep = keeper(spark)
    items = keep(features(spark.createDataFrame(rows, "id long, text string, minute long")), "items")
    spark.sparkContext.setJobGroup("decided", "decided")
    done = decided(items, None, keep, window=72.0, block=30)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("decided"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(done) == 1 and done[0].count() == 120
    assert jobs <= 6 + 5 * 4, jobs


def test_rows_of_a_batch_are_made_once(spark, tmp_path):
    """What makes the rows of a stream of two paths runs once a row, not once for each path and for the newest time."""
    seen = spark.sparkContext.accumulator(0)
    schema = "id long, ts timestamp"
    spark.range(50).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = live.incoming(spark, f"{tmp_path}/in", schema).mapInArrow(count, schema)
    live.two_paths(rows, "ts", "6 hours", f"file://{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert live.merged(spark, schema, f"file://{tmp_path}/out", ["id"], "ts").count() == 50
    assert seen.value == 50


@pytest.mark.parametrize("patterns", [[p for p, _ in V.THEME_RULES], [p for p, _ in V.FILTER_RULES]])
def test_one_pass_for_all_patterns(spark, patterns):
    """One pattern for all finds what any of them finds, in texts with and without Cyrillic letters, whatever the case."""
    words = sorted({w for p in patterns for w in re.findall(r"[^\W\d_]{2,}", p)})
    texts = [f"{a}{w}{b}" for w in words for a in ("", "x ", "x") for b in ("", " y", "y", "я")] + [w.upper() for w in words]
    texts += ["ſteam deck", "ᲀыбор", "promo  code", "promocode!", "t.me/+a", "cve-2024", "gpt-4", "атомный реактор", "ставка", "plain words", "", "job offer", "#реклама", "hr", "hrs"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select("t", F.expr(E.matches_any("t", patterns)).alias("any"), F.expr(" or ".join(E.matches("t", p) for p in patterns)).alias("each")).collect()
    assert [r["t"] for r in both if r["any"] != r["each"]] == []
    assert {r["any"] for r in both} == {True, False}


def test_posts_of_a_graph_are_made_once(spark):
    """Posts are read once for their names and once for their aliases, however often the edges ask for their nodes."""
    seen, schema = spark.sparkContext.accumulator(0), "id long, text string"

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    posts = spark.createDataFrame([(i, f"Some Name{i % 3} met OpenAI and Apple") for i in range(20)], schema).mapInArrow(count, schema)
    edges = G.ingested_edges(spark, G.event_nodes(spark, posts)).collect()
    assert {(e["a"], e["b"]): e["mentions"] for e in edges if e["edge_type"] == "RELATED_TO"}[("apple", "openai")] == 20
    assert seen.value == 40


def test_tokens_of_posts_are_made_once(spark, sf):
    """Posts meet the benchmark three times with tokens that are kept."""
    assert not any("documents" in f for f in queries()["near_dup_vs_benchmark"](spark, sf).inputFiles())
