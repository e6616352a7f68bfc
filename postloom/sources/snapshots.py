"""Snapshots that are built in stages and become current only when they are whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]]


@dataclass(frozen=True)
class Snapshots:
    """Versions of a set of tables under a folder that driver and executors share. A build writes a version's tables stage by stage and marks each stage that is
    whole; started again after it was stopped, it goes on behind the last mark. Readers see the last finished version all the while; the swap is one empty file."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _mark(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.create(p, True).close()

    def current(self) -> int | None:
        """The last finished version."""
        return max(map(int, self._names("finished")), default=None)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            raise LookupError("no version is finished")
        return self.spark.read.parquet(f"{self.root.rstrip('/')}/v={version}/{table}")

    def stages(self, version: int) -> list[str]:
        """Stages of a version that are whole."""
        return self._names(f"v={version}/_stages")

    def rebuild(self, stages: list[tuple[str, Stage]], stop: Callable[[str], bool] = lambda name: False) -> int | None:
        """Runs the stages that the open version still lacks and makes it current; its number, or None if stop(name of the next stage) said so. A stage takes
        a reader of the tables of the stages before and returns its own tables by name."""
        now = self.current()
        version = 0 if now is None else now + 1
        done = set(self.stages(version))
        for name, stage in stages:
            if name in done:
                continue
            if stop(name):
                return None
            for table, df in stage(lambda t: self.read(t, version)).items():
                df.write.mode("overwrite").parquet(f"{self.root.rstrip('/')}/v={version}/{table}")
            self._mark(f"v={version}/_stages/{name}")
        self._mark(f"finished/{version}")
        return version

    def forget(self, keep: int = 2) -> None:
        """Deletes finished versions but the last keep of them."""
        for version in sorted(map(int, self._names("finished")))[:-keep]:
            for path in (f"finished/{version}", f"v={version}"):
                fs, p = self._fs(path)
                fs.delete(p, True)
