"""Recursions along series of any length: a series is cut into blocks that many tasks take.

A step of a linear recursion is a map of the state (affine: h -> a h + b; or a 2 x 2 matrix of two
weights whose ratio matters), and maps compose.  Rows are dealt by ranges of (keys, order), so a long series
spans many partitions and a partition holds many short ones; the first row of a series resets
the state.  Three steps: each partition's product of maps (one row), the states at the partitions'
starts from those few products, and all states from there, block by block.  Nothing is
gathered: a task streams its partition by Arrow batches, and the driver sees one row a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfin.session import checkpoint


class Affine:
    """h -> a h + b; maps are rows (a, b), states rows (h,)."""

    width, states = 2, 1

    @staticmethod
    def identity(n: int) -> np.ndarray:
        return np.tile([1.0, 0.0], (n, 1))

    @staticmethod
    def scaled(maps: np.ndarray) -> np.ndarray:
        return maps

    @staticmethod
    def compose(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.stack([later[..., 0] * earlier[..., 0], later[..., 0] * earlier[..., 1] + later[..., 1]], axis=-1)

    @staticmethod
    def apply(maps: np.ndarray, state: np.ndarray) -> np.ndarray:
        return maps[..., :1] * state + maps[..., 1:]

    @staticmethod
    def reset(state: np.ndarray) -> np.ndarray:
        """The map that gives this state whatever came before."""
        return np.concatenate([np.zeros_like(state), state], axis=-1)


class Weights:
    """Two weights by a 2 x 2 matrix (m00, m01, m10, m11), scaled to sum to one, so that no product runs out of range."""

    width, states = 4, 2

    @staticmethod
    def identity(n: int) -> np.ndarray:
        return np.tile([1.0, 0.0, 0.0, 1.0], (n, 1))

    @staticmethod
    def scaled(maps: np.ndarray) -> np.ndarray:
        """Maps whose largest number is one: two that are tiny would make none."""
        top = maps.max(axis=-1, keepdims=True)
        return maps / np.where(top > 0, top, 1.0)

    @staticmethod
    def compose(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        a, b = later, earlier
        rows = (a[..., 0] * b[..., 0] + a[..., 1] * b[..., 2], a[..., 0] * b[..., 1] + a[..., 1] * b[..., 3], a[..., 2] * b[..., 0] + a[..., 3] * b[..., 2], a[..., 2] * b[..., 1] + a[..., 3] * b[..., 3])
        return Weights.scaled(np.stack(rows, axis=-1))

    @staticmethod
    def apply(maps: np.ndarray, state: np.ndarray) -> np.ndarray:
        made = np.stack([maps[..., 0] * state[..., 0] + maps[..., 1] * state[..., 1], maps[..., 2] * state[..., 0] + maps[..., 3] * state[..., 1]], axis=-1)
        total = made.sum(axis=-1, keepdims=True)
        return made / np.where(total > 0, total, 1.0)

    @staticmethod
    def reset(state: np.ndarray) -> np.ndarray:
        return np.stack([state[..., 0], state[..., 0], state[..., 1], state[..., 1]], axis=-1)


Kind = type[Affine] | type[Weights]


def _columns(kind: Kind, maps: np.ndarray) -> np.ndarray:
    """Maps in rows of about the square root of their number, filled up with identities at the end."""
    n = len(maps)
    wide = isqrt(max(n - 1, 0)) + 1
    tall = -(-n // wide)
    full = kind.identity(tall * wide)
    full[:n] = kind.scaled(maps)
    return full.reshape(tall, wide, kind.width)


def product(kind: Kind, maps: np.ndarray) -> np.ndarray:
    """All maps in turn as one; the first is applied first."""
    if not len(maps):
        return kind.identity(1)[0]
    rows = _columns(kind, maps)
    done = rows[:, 0]
    for j in range(1, rows.shape[1]):
        done = kind.compose(rows[:, j], done)
    total = done[0]
    for row in done[1:]:
        total = kind.compose(row, total)
    return total


def states(kind: Kind, maps: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state after each map: prefix products within rows, all rows at once, then the rows' states in turn."""
    n = len(maps)
    if not n:
        return np.zeros((0, kind.states))
    rows = _columns(kind, maps)
    for j in range(1, rows.shape[1]):
        rows[:, j] = kind.compose(rows[:, j], rows[:, j - 1])
    begin = np.empty((len(rows), kind.states))
    for i in range(len(rows)):
        begin[i] = state
        state = kind.apply(rows[i, -1], state)
    return kind.apply(rows, begin[:, None, :]).reshape(-1, kind.states)[:n]


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """True at rows whose key differs from that of the row before; the first row counts as no start."""
    new = np.zeros(batch.num_rows, bool)
    for k in range(keys):
        column = batch.column(k)
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _key(batch: pa.RecordBatch, row: int, keys: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in range(keys))


def _numbers(batch: pa.RecordBatch, first: int, count: int) -> np.ndarray:
    return np.stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(count)], axis=-1)


def scan_rows(
    df: DataFrame, kind: Kind, maps: Sequence[str], start: Sequence[str], keys: Sequence[str], order: Sequence[str], out: Sequence[str], carry: Sequence[str] = (), blocks: int | None = None, after: bool = False
) -> DataFrame:
    """(keys, order, carry, out): each row's state before its map, or ``after`` it.

    maps: the double columns of a row's map; start: those of the state before a key's first row, the same
    in all its rows; order: what rows of a key are sorted by, ties by what comes later in ``carry``.
    Null keys are one key.  ``blocks`` is the number of ranges (the session's shuffle partitions without it), whatever the keys.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [*keys, *order, *carry]
    kept = df.select(*names, *(F.col(c).alias(f"_map{i}") for i, c in enumerate(maps)), *(F.col(c).alias(f"_start{i}") for i, c in enumerate(start)))
    dealt = kept.repartitionByRange(blocks, *keys, *order).sortWithinPartitions(*names)
    rows = checkpoint(dealt.withColumn("_block", F.spark_partition_id()))
    n_keys, at_maps, at_start, at_block = len(keys), len(names), len(names) + kind.width, len(names) + kind.width + kind.states
    types = dict(rows.dtypes)
    key_schema = ", ".join(f"{side}{k} {types[c]}" for side in ("_first", "_last") for k, c in enumerate(keys))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, last, begin, block = kind.identity(1)[0], None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            steps, new = _numbers(batch, at_maps, kind.width), _starts(batch, n_keys)
            here = _key(batch, 0, n_keys)
            if first is None:
                first, block, begin = here, batch.column(at_block)[0].as_py(), _numbers(batch.slice(0, 1), at_start, kind.states)[0]
            elif here != last:
                new[0] = True
            resets = kind.reset(_numbers(batch, at_start, kind.states)[new])
            steps[new] = kind.compose(steps[new], resets)
            total = kind.compose(product(kind, steps), total)
            last = _key(batch, batch.num_rows - 1, n_keys)
        if first is not None:
            values = [[block], *([v] for v in first + last), *([float(v)] for v in (*begin, *total))]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, summary_schema)], schema=summary_schema)

    numbers = [*(f"_begin{k}" for k in range(kind.states)), *(f"_total{k}" for k in range(kind.width))]
    declared = f"_block int, {key_schema}, " + ", ".join(f"{c} double" for c in numbers)
    summary_schema = _arrow_schema(spark, declared)
    summaries = sorted(rows.mapInArrow(products, declared).collect(), key=lambda r: r["_block"])  # one row a block
    entries, state, last = {}, np.zeros(kind.states), None
    for r in summaries:
        first = tuple(r[f"_first{k}"] for k in range(n_keys))
        if first != last:
            state = np.array([r[f"_begin{k}"] for k in range(kind.states)])
        entries[r["_block"]] = state
        state = kind.apply(np.array([r[f"_total{k}"] for k in range(kind.width)]), state)
        last = tuple(r[f"_last{k}"] for k in range(n_keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            steps, new = _numbers(batch, at_maps, kind.width), _starts(batch, n_keys)
            if state is None:
                state = entries[batch.column(at_block)[0].as_py()]
            elif _key(batch, 0, n_keys) != last:
                new[0] = True
            begin = _numbers(batch, at_start, kind.states)
            steps[new] = kind.compose(steps[new], kind.reset(begin[new]))
            found = states(kind, steps, state)
            if after:
                made = found
            else:
                made = np.concatenate([state[None], found[:-1]])
                made[new] = begin[new]
            state, last = found[-1], _key(batch, batch.num_rows - 1, n_keys)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *(pa.array(made[:, k], from_pandas=True) for k in range(kind.states))], [*names, *out])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in names), *(f"`{c}` double" for c in out)]))


def _arrow_schema(spark, declared: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], declared).schema)


def with_moments(df: DataFrame, value: str, keys: Sequence[str], moments: dict[str, Callable]) -> DataFrame:
    """df with aggregates of its keys' values.  They are partially aggregated and joined back, so that no key's rows meet in one task; adaptive execution splits a hot key's join."""
    from tallyfin.session import small

    made = df.groupBy(*keys).agg(*(f(F.col(value)).alias(c) for c, f in moments.items()))
    renamed = small(checkpoint(made.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *moments)))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(renamed, on).drop(*(f"_k{i}" for i in range(len(keys))))
