"""Operator 3: embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised; with cosine >= 0.98 two of them lie within 0.2 of each other. Each of TABLES tables quantises
PROJECTIONS random Gaussian projections to cells of WIDTH and joins them into a bucket key; vectors of one label that share a
key in any table are compared by exact double-precision cosine.

* Equal vectors of a label are grouped first and take part once, with their number.
* Only buckets of two vectors or more are kept (counts are pre-aggregated), and only their vectors travel.
* A bucket is split into blocks by a hash of the id; a task gets two blocks (or one), never a whole bucket, and works by
  matrix products. Pairs never become rows: a task returns each vector's number of links and a spanning forest of them.
* A pair that meets in several tables counts where it first meets: every vector carries its keys.

A pair at cosine 0.98 exactly is missed with probability below 0.001, one at 0.99 with below 1e-5 (see miss_rate); none
below 0.98 is linked. Null labels, null, empty or zero vectors and those with null or non-finite components link with
nothing and are their own class; vectors of different length are never equal or compared. Repeated vec_ids are one vertex
each row of which is returned; a null vec_id is returned with no links. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, Scratch, components
from .grouped import map_groups

TABLES, PROJECTIONS, WIDTH, BLOCK, SEED = 48, 16, 1.6, 512, 20_24


def miss_rate(cosine: float, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> float:
    """Probability that two unit vectors of this cosine share no bucket."""
    d = math.sqrt(max(0.0, 2 - 2 * cosine))
    if d == 0:
        return 0.0
    r = width / d
    one = math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return (1 - one**projections) ** tables


@lru_cache(maxsize=4)
def _planes(dim: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + dim)
    mix = rng.integers(1, 2**63, size=projections, dtype=np.uint64) | np.uint64(1)
    return rng.standard_normal((dim, tables * projections)) / width, rng.random(tables * projections), mix


def bucket_keys(unit: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """(n, tables) int64 keys of unit vectors."""
    a, b, mix = _planes(unit.shape[1], tables, projections, width)
    cells = np.floor(unit @ a + b).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    with np.errstate(over="ignore"):
        h = (cells * mix).sum(2, dtype=np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _hashed(tables: int, projections: int, width: float):
    def run(batches):
        for b in batches:
            lists = b.column("embedding").to_pylist()
            by_len: dict[int, list[int]] = {}
            for i, x in enumerate(lists):
                by_len.setdefault(len(x), []).append(i)
            for rows in by_len.values():
                v = np.array([lists[i] for i in rows], np.float64)
                unit = v / np.sqrt((v * v).sum(1, keepdims=True))
                keys = bucket_keys(unit, tables, projections, width)
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep").take(pick), b.column("label").take(pick), b.column("copies").take(pick), pa.array([x.tobytes() for x in unit], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())],
                    ["rep", "label", "copies", "unit", "keys"],
                )

    return run


def _postings(batches):
    for b in batches:
        keys = [np.frombuffer(x, np.int64) for x in b.column("keys").to_pylist()]
        if not keys:
            continue
        t = len(keys[0])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(b.column("rep").to_numpy(), t)), pa.array(np.tile(np.arange(t, dtype=np.int32), len(keys))), pa.array(np.concatenate(keys)),
                b.column("label").take(pa.array(np.repeat(np.arange(len(keys)), t))),
            ],
            ["rep", "tab", "key", "label"],
        )


def _linked(cosine: float):
    """Links inside one group: (vertex, links counted with copies, a neighbour in a spanning forest or itself)."""

    def run(rows: pa.Table):
        if rows.num_rows < 2:
            return
        t = rows.column("tab")[0].as_py()
        unit = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(rows.num_rows, -1)
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(rows.num_rows, -1)
        rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        side = rows.column("block").to_numpy() == j
        links, forest, edges = np.zeros(len(rep), np.int64), Forest(len(rep)), []
        for at in range(0, len(rep), 256):
            s = unit[at : at + 256] @ unit.T
            a, b = np.nonzero(s >= cosine - 1e-9)
            a = a + at
            keep = a < b
            if i != j:
                keep &= side[a] != side[b]
            a, b = a[keep], b[keep]
            for k in range(0, len(a), 65_536):
                x, y = a[k : k + 65_536], b[k : k + 65_536]
                new = (unit[x] * unit[y]).sum(1) >= cosine
                if t:
                    new &= ~(keys[x, :t] == keys[y, :t]).any(1)
                x, y = x[new], y[new]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    if forest.union(p, q):
                        edges.append((p, q))
        seen = np.flatnonzero(links)
        if len(seen):
            e = np.array(edges, np.int64).reshape(-1, 2)
            out = np.concatenate([rep[seen], rep[e[:, 0]]]), np.concatenate([rep[seen], rep[e[:, 1]]]), np.concatenate([links[seen], np.zeros(len(e), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b", "links"])

    return run


def near_vectors(
    spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    scratch = Scratch(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.expr("vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    # -0.0 and 0.0 are one value to the grouping
    own = v.where(fine).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    hashed = scratch.save(own.select("rep", "label", "copies", "embedding").mapInArrow(_hashed(tables, projections, width), "rep long, label string, copies long, unit binary, keys binary"), "hashed")
    postings = hashed.select("rep", "label", "keys").mapInArrow(_postings, "rep long, tab int, key long, label string")
    full = postings.groupBy("label", "tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = scratch.save(full.select("label", "tab", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "full")
    # each vector goes to as many groups as its bucket has blocks: (i, j) with its own block on either side
    member = (
        postings.join(full, ["label", "tab", "key"])
        .withColumn("block", F.pmod(F.xxhash64("rep", "tab"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "label", "tab", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(hashed.select("rep", "copies", "unit", "keys"), "rep")
    )
    found = scratch.save(map_groups(member, ["label", "tab", "key", "i", "j"], _linked(cosine), "a long, b long, links long"), "found")
    label_of = components(spark, found.where("a <> b").select("a", "b"), scratch)
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    per_rep = (
        own.join(links, F.col("rep") == F.col("a"), "left")
        .join(label_of.select("v", F.col("label").alias("component")), F.col("rep") == F.col("v"), "left")
        .select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    flagged = v.withColumn("fine", fine)
    out = flagged.where("fine").join(per_rep, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    rest = flagged.where("fine is null or not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
