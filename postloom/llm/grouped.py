"""Many small groups per Arrow batch: rows sorted by key within partitions, cut at key changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alone


def consecutive(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(values of the keys, rows) of each run of rows with equal keys."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        values = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(v[x] for v in values)
            if held and now != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
            last = now
    if held:
        yield last, pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], one: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """one(rows of a group) for every value of the keys. As applyInPandas, but without a batch for each group, which costs
    more than the work where groups are small. The caller bounds the size of groups."""

    def run(batches):
        alone()
        for _, rows in consecutive(batches, keys):
            yield from one(rows)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
