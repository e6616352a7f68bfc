"""Helpers shared by the numbered operators: shared scratch tables, component labelling, bounded memo."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests);
    on a cluster that is an error, because executors do not see each other's temporary folders."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    root = getattr(shared_dir, "own", None)
    if root is None:
        root = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="postloom-")
    return root


class Scratch:
    """Parquet tables in the shared folder. They cut lineage, so a lost executor costs at most the stage that was running."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.paths.pop(name, None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone; the folder is scratch
            pass


def _forests(edges: DataFrame, slice_rows: int = 1 << 20) -> DataFrame:
    """Edges (a, b) with the same components: each task joins its own edges by union-find, some million at a time, and returns
    one edge from every vertex to the smallest one that it reached. Narrow; what a hub has in a task becomes one star."""

    def stars(held):
        a, b = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in ("a", "b"))
        vertex, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(vertex))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            forest.union(x, y)
        root = np.fromiter(map(forest.find, range(len(vertex))), np.int64, len(vertex))
        leaf = np.flatnonzero(root != np.arange(len(vertex)))
        return pa.RecordBatch.from_arrays([pa.array(vertex[root[leaf]]), pa.array(vertex[leaf])], ["a", "b"])

    def run(batches):
        alone()
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= slice_rows:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    return edges.select("a", "b").where("a <> b").mapInArrow(run, "a long, b long")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long) as (v, label): label is the smallest vertex of the component.

    Each task first joins its own edges (_forests). Then every round points each vertex at the neighbour of the lowest rank and
    contracts the edges to the pointers' ends. Ranks are ids at first, which settles stars, and from the third round on a hash
    of id and round, so that no order of ids makes long chains of pointers: rounds are logarithmic in expectation. Only vertices
    of edges are returned. Hubs: the lowest rank is pre-aggregated before the shuffle, joins may be split.
    """
    live = scratch.save(_forests(edges), f"{name}e")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        turn = len(maps)
        rank = (lambda c: F.col(c)) if turn < 2 else (lambda c, t=turn: F.xxhash64(F.col(c), F.lit(t)))
        both = live.select(F.col("b").alias("v"), F.col("a").alias("n")).unionAll(live.select(F.col("a").alias("v"), F.col("b").alias("n")))
        lowest = both.groupBy("v").agg(F.min(F.struct(rank("n").alias("r"), F.col("n").alias("n"))).alias("m"))
        ptr = scratch.save(lowest.select("v", F.least("m", F.struct(rank("v").alias("r"), F.col("v").alias("n")))["n"].alias("p")), f"{name}p{turn}")
        maps.append(ptr)
        of_a = ptr.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        of_b = ptr.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        new = scratch.save(_forests(live.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), f"{name}e{turn}")
        scratch.drop(f"{name}e" if turn == 0 else f"{name}e{turn - 1}")
        live = new
    if not maps:
        return spark.createDataFrame([], "v long, label long")
    labels = maps[0].select("v", F.col("p").alias("label"))
    for later in maps[1:]:
        later = later.select(F.col("v").alias("label"), F.col("p").alias("to"))
        labels = labels.join(later, "label", "left").select("v", F.coalesce("to", "label").alias("label"))
    if len(maps) > 2:  # the roots are those of the lowest hashes
        labels = scratch.save(labels, f"{name}l")
        least = labels.groupBy("label").agg(F.min("v").alias("least"))
        labels = labels.join(least, "label").select("v", F.col("least").alias("label"))
    return labels


def held_out_column(id_col: str) -> "F.Column":
    """crc32 of the id's decimal text, mod 5 equals 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def crc_fold(value: object) -> int:
    return zlib.crc32(str(value).encode()) % 5


class Memo(dict):
    """A dict that computes missing values. At its bound it becomes the older generation, whose entries move back on use;
    the bound changes speed only."""

    def __init__(self, compute, bound: int = 300_000):
        super().__init__()
        self.compute, self.bound, self.older = compute, bound, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


#: Tables that stay in a Python worker between its tasks, by name.
_resident: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]) -> object:
    """A table that a Python worker keeps for its next tasks. Workers serve stages of all operators: a table of another name is freed first."""
    alone(name)
    if name not in _resident:
        _resident[name] = make()
    return _resident[name]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut short, so that a map of single rows has Python objects of some texts at a time, not of a whole batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def alone(name: str = "") -> None:
    """Frees what tasks of other stages have left in this Python worker: their tables, and Arrow's unused memory."""
    others = [k for k in _resident if k != name]
    for k in others:
        del _resident[k]
    if others:
        gc.collect()  # they hold methods of themselves
    if pa.default_memory_pool().backend_name != "system":  # one allocator for all, which gives back what is free
        pa.set_memory_pool(pa.system_memory_pool())
    _trim()


def _trim() -> None:
    """Returns free memory of the C library to the system, where it can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def arrow_strings(column) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def uint64_of(longs) -> np.ndarray:
    return np.asarray(longs, dtype=np.int64).view(np.uint64)
