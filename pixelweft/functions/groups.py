"""Kernels over whole groups of rows, many small ones in a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of a call, unless a single group has more.
BATCH = 1 << 17


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where a group begins."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for k in keys:
        c = t.column(k).combine_chunks()
        a, b = c[1:], c[:-1]
        differ = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def over_groups(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What kernel(rows, starts) yields, of the rows of whole groups in the order of keys and order; starts are the places of the groups' first rows.

    Groups are dealt to as many partitions as shuffles have: few bytes make much work
    here, so partitions are not to be joined by size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, BATCH
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                t = pa.Table.from_batches(held)
                starts = _starts(t, keys)
                if len(starts) > 1:
                    yield from kernel(t.slice(0, starts[-1]), starts[:-1])
                    t = t.slice(starts[-1])
                held, n = t.to_batches(), t.num_rows
                most = max(BATCH, 2 * n)  # so a large group is not gone through with every batch
        if n:
            t = pa.Table.from_batches(held)
            yield from kernel(t, _starts(t, keys))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
