"""Quantiles of long moving frames: an order statistic kept as the frame moves, in blocks that many tasks take.

Rows are dealt by ranges of (keys, order) as in ``functions.blocks``.  A block's first frames reach
back into the blocks before it: each block tells its last ``rows`` values (of its last key), and
the driver hands each block those it needs, blocks times ``rows`` numbers at most.  Within a block
the frame is a tree of counts over the ranks of the values (Fenwick's), so a row costs a
logarithm, however long the frame.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfin.functions.blocks import _arrow_schema, _key, _starts
from tallyfin.session import checkpoint

#: Numbers that are handed to blocks at most (128 MB).
MOST_HANDED = 1 << 24


class Ranks:
    """How many values of each rank are in the frame, as Fenwick's tree: adding, removing and finding the k-th cost a logarithm."""

    def __init__(self, size: int):
        self.size, self.tree, self.count = size, [0] * (size + 1), 0
        self.top = 1 << (size.bit_length() - 1) if size else 0

    def add(self, rank: int, n: int) -> None:
        self.count += n
        at, tree, size = rank + 1, self.tree, self.size
        while at <= size:
            tree[at] += n
            at += at & -at

    def find(self, k: int) -> int:
        """The rank of the k-th value (from 0) of the frame."""
        at, step, tree, size = 0, self.top, self.tree, self.size
        while step:
            to = at + step
            if to <= size and tree[to] <= k:
                at = to
                k -= tree[to]
            step >>= 1
        return at


def moving_quantiles(values: np.ndarray, begin: int, rows: int, level: float) -> np.ndarray:
    """Of each value from ``begin`` on, the interpolated quantile of the ``rows`` values before it; NaN where there are fewer, or one of them is NaN."""
    out = np.full(len(values) - begin, np.nan)
    first = max(0, begin - rows)
    used = values[first:]
    told = ~np.isnan(used)
    order = np.unique(used[told])
    ranks = np.searchsorted(order, used)
    frame, sorted_, present, at_rank = Ranks(len(order)), order.tolist(), told.tolist(), ranks.tolist()
    h = (rows - 1) * level
    low, high = int(np.floor(h)), int(np.ceil(h))
    for i in range(len(used)):
        if i >= begin - first and i + first >= rows and frame.count == rows:
            a = sorted_[frame.find(low)]
            b = a if high == low else sorted_[frame.find(high)]
            out[i - (begin - first)] = a if a == b else (high - h) * a + (h - low) * b
        if i >= rows and present[i - rows]:
            frame.add(at_rank[i - rows], -1)
        if present[i]:
            frame.add(at_rank[i], 1)
    return out


def rolling_quantile(df: DataFrame, value: str, rows: int, level: float, keys: Sequence[str], order: Sequence[str], out: str, blocks: int | None = None) -> DataFrame:
    """(keys, order, value, out): the interpolated quantile of the ``rows`` values before each row, null where the frame is not full of values.

    Rows of one moment are in order of their value (null first); null keys are one key.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if blocks * rows > MOST_HANDED:
        raise ValueError(f"{blocks} blocks of frames of {rows} rows: more than {MOST_HANDED} numbers to hand on; take fewer blocks")
    names, n_keys = [*keys, *order, "_v"], len(keys)
    kept = df.select(*keys, *order, F.col(value).cast("double").alias("_v"))
    held = checkpoint(kept.repartitionByRange(blocks, *keys, *order).sortWithinPartitions(*names).withColumn("_block", F.spark_partition_id()))
    types = dict(held.dtypes)
    at_value, at_block = len(names) - 1, len(names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, bool, np.ndarray]]:
        """(batch, start, end, is a new key, values) of each run of rows of one key in a batch."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, n_keys)
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            values = batch.column(at_value).to_numpy(zero_copy_only=False).astype(np.float64)
            fresh = last is None or _key(batch, 0, n_keys) != last
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield batch, a, b, fresh, values[a:b]
                fresh = True
            last = _key(batch, batch.num_rows - 1, n_keys)

    key_schema = ", ".join(f"{side}{k} {types[c]}" for side in ("_first", "_last") for k, c in enumerate(keys))
    declared = f"_block int, {key_schema}, _one boolean, _tail binary"
    schema = _arrow_schema(spark, declared)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = block = None
        tail, one = np.zeros(0), True
        for batch, a, b, fresh, values in pieces(batches):
            if first is None:
                first, block = _key(batch, a, n_keys), batch.column(at_block)[0].as_py()
            elif fresh:
                one, tail = False, tail[:0]
            tail = np.concatenate([tail, values])[-rows:]
            last = _key(batch, b - 1, n_keys)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([block, *first, *last, one, tail.tobytes()], schema)], schema=schema)

    handed, before, last = {}, np.zeros(0), None
    for r in sorted(held.mapInArrow(tails, declared).collect(), key=lambda r: r["_block"]):  # a block's last values
        first = tuple(r[f"_first{k}"] for k in range(n_keys))
        before = before if first == last else before[:0]
        handed[r["_block"]] = before
        tail = np.frombuffer(r["_tail"])
        before = np.concatenate([before, tail])[-rows:] if r["_one"] else tail
        last = tuple(r[f"_last{k}"] for k in range(n_keys))
    shared = spark.sparkContext.broadcast(handed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, begun, current, made = np.zeros(0), False, None, []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(current.column(k) for k in range(len(names))), pa.array(np.concatenate(made), from_pandas=True)], [*names, out])

        for batch, _, _, fresh, values in pieces(batches):
            if current is not None and batch is not current:
                yield close()
                made = []
            current = batch
            if not begun:
                tail, begun = shared.value[batch.column(at_block)[0].as_py()], True
            elif fresh:
                tail = tail[:0]
            both = np.concatenate([tail, values])
            made.append(moving_quantiles(both, len(tail), rows, level))
            tail = both[-rows:]
        if current is not None:
            yield close()

    found = held.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in names), f"`{out}` double"]))
    return found.withColumnRenamed("_v", value)
