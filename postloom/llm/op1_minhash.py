"""Operator 1: MinHash near-duplicates by a signature-coordinate inverted join.

1. A document's set is its distinct word shingles; its signature is the minimum of each of COORDINATES hash functions over the
   set. Documents with equal sets are one vertex from here on.
2. Every document is posted under each (coordinate, value). Sets of the wanted similarity share MATCHES coordinates or more
   (but for a chance of about 1e-6 at the threshold itself, see miss_rate). So of a document's postings, ordered by how many
   documents they hold, those in its *prefix* (the COORDINATES - MATCHES + 1 rarest) hold every partner. A document with fewer
   than MATCHES shared postings has no partner at all. So a passage that a third of all documents hold makes no long list
   unless it is most of each document. Documents that a chain of prefix postings joins form a candidate cluster.
3. Clusters are cut into blocks of bounded size by a hash of the id; a few hub documents of a large cluster are in each of its
   blocks. A task inverts its block: for each document the short posting lists are merged, which counts collisions, and the
   long ones are *skipped* through - only the documents met so far are searched in them - until too few lists are left to
   reach MATCHES. Pairs that reach it are confirmed on the full sets, most collisions first. Documents that are connected
   already need no counting: their link would change no component.
4. In clusters of several blocks, documents outside the cluster's largest component are then merged with every block.
   So all pairs with MATCHES collisions are either confirmed, refuted or within one component, and no pair is ever a row.

Texts that are null, empty or without words have no shingle and link with nothing. Rows with the same doc_id are one document
with the links of all its texts; every row is returned, with the size of its own set. A null doc_id is returned with a null
component and kept true. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, alone, components, slices
from .grouped import map_groups
from .shingles import Shingler

COORDINATES, MATCHES, BLOCK, HUBS, SEED = 64, 36, 512, 32, 77
#: Members of clusters up to which (id, cluster, size) are broadcast to the scan of texts (some 16 MB); beyond it, a shuffled join.
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 2**63, size=(256, 1), dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, size=(256, 1), dtype=np.uint64) | np.uint64(1)


def miss_rate(similarity: float, coordinates: int = COORDINATES, matches: int = MATCHES) -> float:
    """Probability that two sets of this similarity share fewer than ``matches`` coordinates."""
    return sum(math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k) for k in range(matches))


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Minimum of each hash function over a set that is not empty, as uint32."""
    low = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2_048):
            low = np.minimum(low, ((shingles[at : at + 2_048] ^ _XOR[:coordinates]) * _MUL[:coordinates]).min(1))
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _signed(width: int, coordinates: int):
    def run(batches):
        alone()
        shingle = Shingler(width)
        for b in slices(batches):
            n, digest, sig = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle(text or "")
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(signature(s, coordinates).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return run


def _posted(batches):
    alone()
    for b in slices(batches):
        sigs = [np.frombuffer(x, np.uint32) for x in b.column("sig").to_pylist()]
        if sigs:
            k = len(sigs[0])
            keys = (np.concatenate(sigs).astype(np.int64)) | np.tile(np.arange(k, dtype=np.int64) << 32, len(sigs))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("doc").to_numpy(), k)), pa.array(keys)], ["doc", "key"])


def _with_sets(width: int, coordinates: int):
    """Sets and signatures of the members, made again from their texts: that is cheaper than sending either."""

    def run(batches):
        alone()
        shingle = Shingler(width)
        for b in slices(batches):
            sets = [shingle(t or "") for t in b.column("text").to_pylist()]
            full = pa.array([len(s) > 0 for s in sets])
            cols = {n: b.column(n).filter(full) for n in ("doc", "cluster", "size")}
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([signature(s, coordinates).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], [*cols, "sig", "shingles"])

    return run


class _Block:
    """The members of one group, inverted by (coordinate, value)."""

    def __init__(self, rows: pa.Table, percent: int, matches: int):
        self.ids = rows.column("doc").to_numpy()
        self.sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.percent, self.matches = percent, matches
        sig = np.stack([np.frombuffer(x, np.uint32) for x in rows.column("sig").to_pylist()]).astype(np.int64)
        n, k = sig.shape
        _, lists = np.unique(sig | np.arange(k, dtype=np.int64) << 32, return_inverse=True)
        self.lists = lists.reshape(n, k)  # the posting lists of each document
        order = np.argsort(self.lists, axis=None, kind="stable")
        self.members = order // k  # posting lists one after another, documents rising in each
        self.length = np.bincount(self.lists.ravel())
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.postings = self.lists.ravel()[order] * n + self.members  # (list, document) as one rising key
        self.comp = np.arange(n)

    def merged(self, i: int, open_: np.ndarray, step: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """(documents, collisions) of the open documents that collide with i in MATCHES coordinates or more."""
        own = self.lists[i]
        own = own[self.length[own] > 1]
        none = np.zeros(0, np.int64)
        if len(own) < self.matches:
            return none, none
        own = own[np.argsort(self.length[own], kind="stable")]
        prefix, rest = own[: len(own) - self.matches + 1], own[len(own) - self.matches + 1 :]
        found = np.concatenate([self.members[self.begin[x] : self.begin[x] + self.length[x]] for x in prefix])
        found, hits = np.unique(found[open_[found]], return_counts=True)
        for at in range(0, len(rest), step):
            if not len(found):
                break
            part = rest[at : at + step]
            key = part[:, None] * len(self.ids) + found
            hits = hits + (self.postings[np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)] == key).sum(0)
            able = hits + (len(rest) - at - len(part)) >= self.matches
            found, hits = found[able], hits[able]
        reach = hits >= self.matches
        return found[reach], hits[reach]

    def alike(self, i: int, j: int) -> bool:
        both = np.concatenate([self.sets[i], self.sets[j]])
        both.sort(kind="stable")
        same = int((both[1:] == both[:-1]).sum())
        return 100 * same >= self.percent * (len(both) - same)

    def edges(self, asking: np.ndarray, later: bool) -> Iterator[pa.RecordBatch]:
        """Confirmed links of the asking documents with all others, or with those after them, that join two components."""
        out = []
        for i in asking.tolist():
            n, m = self.size[i], self.size
            open_ = (np.minimum(n, m) * 100 >= self.percent * np.maximum(n, m)) & (self.comp != self.comp[i])
            if later:
                open_[:i] = False
            if not open_.any():
                continue
            found, hits = self.merged(i, open_)
            for j in found[np.argsort(-hits, kind="stable")].tolist():
                if self.comp[i] != self.comp[j] and self.alike(i, j):
                    self.comp[self.comp == self.comp[j]] = self.comp[i]
                    out.append((i, j))
        if out:
            e = np.array(out)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[e[:, 0]]), pa.array(self.ids[e[:, 1]])], ["a", "b"])


def _within(matches: int, percent: int):
    def one(rows: pa.Table):
        if rows.num_rows > 1:
            yield from _Block(rows, percent, matches).edges(np.arange(rows.num_rows - 1), later=True)

    return one


def _across(matches: int, percent: int):
    """Stragglers of the group against all of it that is in another component."""

    def one(rows: pa.Table):
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        if not asks.any() or rows.num_rows < 2:
            return
        block = _Block(rows, percent, matches)
        block.comp = np.unique(rows.column("comp").to_numpy(), return_inverse=True)[1]
        yield from block.edges(np.flatnonzero(asks), later=False)

    return one


def near_duplicates(
    spark: SparkSession, docs: DataFrame, width: int = 4, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: components of 100 * intersection >= percent * union."""
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(texts.mapInArrow(_signed(width, coordinates), "doc_id long, n_shingles long, digest binary, sig binary"), "signed")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("doc_id")
    if not several.isEmpty():
        return _ids_of_several_texts(spark, texts, several, scratch, lambda t: near_duplicates(spark, t, width, percent, coordinates, matches, block))
    reps = signed.where("sig is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))
    reps = scratch.save(reps, "reps")

    postings = reps.select("doc", "sig").mapInArrow(_posted, "doc long, key long")
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("doc")  # at most one row a coordinate
    ranked = postings.join(shared, "key").select("doc", "key", F.row_number().over(own.orderBy("df", "key")).alias("k"), F.count(F.lit(1)).over(own).alias("n"))
    prefix = scratch.save(ranked.where(F.col("k") <= F.col("n") - (matches - 1)).select("doc", "key"), "prefix")
    heads = prefix.groupBy("key").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head")
    cluster = components(spark, prefix.join(heads, "key").select(F.col("doc").alias("a"), F.col("head").alias("b")), scratch, "cand")
    cluster = scratch.save(cluster.select(F.col("v").alias("doc"), F.col("label").alias("cluster")), "cluster")
    sizes = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ids = scratch.save(cluster.join(sizes, "cluster").select("doc", "cluster", "size"), "members")
    few = ids.count() <= BROADCAST_ROWS
    with_text = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"] == ids["doc"])
    sets = scratch.save(with_text.select("doc", "cluster", "size", "text").mapInArrow(_with_sets(width, coordinates), "doc long, cluster long, size long, sig binary, shingles binary"), "sets")
    sets = sets.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))

    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("doc", F.lit(SEED)), F.col("size")) < HUBS)
    placed = sets.withColumn("at", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    edges = scratch.save(map_groups(placed.select("cluster", "at", "doc", "sig", "shingles"), ["cluster", "at"], _within(matches, percent), "a long, b long"), "edges")

    large = sets.where("blocks > 1")
    if not large.isEmpty():
        comp = components(spark, edges, scratch, "first")
        large = large.join(comp.withColumnRenamed("v", "doc"), "doc", "left").withColumn("comp", F.coalesce("label", "doc"))
        parts = large.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
        large = scratch.save(
            large.join(main.where("others > 0"), "cluster").select("cluster", "doc", "sig", "shingles", "comp", "block", "blocks", (F.col("comp") != F.col("main")).alias("straggler"), F.ceil(F.col("others") / block).cast("int").alias("asking")),
            "large",
        )
        # a group is a block of the cluster with a block of its stragglers
        asked = large.select("cluster", F.col("block").alias("at"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("by"), "doc", "sig", "shingles", "comp", F.lit(False).alias("asks"))
        asking = large.where("straggler").select(
            "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), F.pmod(F.xxhash64("doc", F.lit(SEED + 1)), F.col("asking")).cast("int").alias("by"), "doc", "sig", "shingles", "comp", F.lit(True).alias("asks")
        )
        more = map_groups(asked.unionAll(asking), ["cluster", "at", "by"], _across(matches, percent), "a long, b long")
        edges = edges.unionAll(scratch.save(more, "more"))

    label = components(spark, edges, scratch, "final")
    of_digest = reps.select("digest", "doc").join(label, F.col("doc") == F.col("v"), "left").select(F.col("digest").alias("d"), F.coalesce("label", "doc").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    linked = out.where("digest is not null").join(of_digest, F.col("digest") == F.col("d"), "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    alone = out.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _ids_of_several_texts(spark: SparkSession, texts: DataFrame, several: DataFrame, scratch: Scratch, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result where rows of one id differ: each of their texts is linked under an id of its own (below zero), and then joined
    with the others of its id."""
    own = F.when(F.col("odd"), -1 - F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 1)).otherwise(F.col("doc_id"))
    marked = texts.join(several.withColumn("odd", F.lit(True)), "doc_id", "left").select(own.alias("own"), "doc_id", "text")
    names = scratch.save(marked.where("own <> doc_id").select("own", F.col("doc_id").alias("real")).distinct(), "names")
    found = scratch.save(linked(marked.select(F.col("own").alias("doc_id"), "text")).join(names, F.col("doc_id") == F.col("own"), "left").drop("own"), "found")
    edges = found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    label = components(spark, edges.unionAll(names.select("own", "real")), scratch, "ids")
    rows = found.join(label, F.col("doc_id") == F.col("v"), "left").select(F.coalesce("real", "doc_id").alias("doc_id"), "n_shingles", F.coalesce("label", "doc_id").alias("label"))
    least = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least.withColumnRenamed("label", "l"), F.col("label") == F.col("l"), "left").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
