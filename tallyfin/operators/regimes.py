"""Two normal regimes: smoothed probabilities and parameters fitted by expectation-maximisation, over series in blocks.

Rows are sorted once, by ranges of (keys, order).  Each step passes them twice: once for each block's products
of 2 x 2 matrices, from which the forward weights at a block's start and the backward weights at its end follow (the
same product serves both ways), and once for what is summed by key.  Only a few numbers a key and block are
shuffled; a task holds the numbers of its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfin.functions.blocks import Weights, _arrow_schema, _key, _starts, product, states
from tallyfin.session import MOST_BROADCAST, checkpoint, written

#: Parameters of a key: mean and deviation of either regime, and how likely each stays.
PARAMS = ("calm_mean", "calm_std", "wild_mean", "wild_std", "calm_stay", "wild_stay")
#: Expected counts of a key: weights, first and second moments about the old mean, moves from regime to regime, and the likelihood's logarithm.
SUMS = ("n0", "n1", "s0", "s1", "q0", "q1", "m00", "m01", "m10", "m11", "loglik")
#: Least variance of a regime, as a share of the series' own.
FLOOR = 1e-6


def _likely(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Densities of both regimes by row; a row of none in either, or without a value, is told by neither."""
    z = (x[:, None] - p[:, [0, 2]]) / p[:, [1, 3]]
    d = np.exp(-z * z / 2) / (np.sqrt(2 * np.pi) * p[:, [1, 3]])
    dumb = ~(d.sum(axis=1) > 0)
    d[dumb] = 1.0
    return d


def _moves(p: np.ndarray) -> np.ndarray:
    """Rows (calm to calm, calm to wild, wild to calm, wild to wild)."""
    return np.stack([p[:, 4], 1 - p[:, 4], 1 - p[:, 5], p[:, 5]], axis=1)


def _maps(d: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The matrix that takes the weights before a row to those after it."""
    return np.stack([d[:, 0] * t[:, 0], d[:, 0] * t[:, 2], d[:, 1] * t[:, 1], d[:, 1] * t[:, 3]], axis=1)


HALF = np.array([0.5, 0.5])


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray] | None:
    """All of a block: the rows, values, parameters, and where a key begins (its first row is told by the block before)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    x = block.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
    p = np.stack([block.column(4 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(PARAMS))], axis=1)
    return block, x, p, _starts(block, 1)


def _smooth(block: pa.RecordBatch, x: np.ndarray, p: np.ndarray, new: np.ndarray, entries: dict) -> tuple[np.ndarray, ...]:
    """Forward weights before and after each row, backward weights after it, densities, moves, and starts of keys."""
    state, after, begins = entries[block.column(3)[0].as_py()]
    new = new.copy()
    new[0] = begins
    d, t = _likely(x, p), _moves(p)
    maps = _maps(d, t)
    forward = maps.copy()
    forward[new] = Weights.compose(forward[new], Weights.reset(np.tile(HALF, (int(new.sum()), 1))))
    done = states(Weights, forward, state)
    before = np.concatenate([state[None], done[:-1]])
    before[new] = HALF
    back = maps[:, [0, 2, 1, 3]]
    back[new] = Weights.reset(HALF)  # a key's last row knows nothing of the next key
    behind = states(Weights, back[::-1], after)[::-1]  # the weights before each row
    beyond = np.concatenate([behind[1:], after[None]])
    return before, done, beyond, d, t, new


class _Blocks:
    """Sorted rows (key, order, value, _block) and the passes over them."""

    def __init__(self, df: DataFrame, value: str, order: str, keys: str, blocks: int | None):
        blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kept = df.select(F.col(keys).alias("k"), F.col(order).alias("t"), F.col(value).cast("double").alias("v"))
        self.rows = checkpoint(kept.repartitionByRange(blocks, "k", "t").sortWithinPartitions("k", "t", "v").withColumn("_block", F.spark_partition_id()))
        self.kinds = dict(self.rows.dtypes)
        self.spark = df.sparkSession

    def with_params(self, params: DataFrame) -> DataFrame:
        """Rows with their key's parameters, in the same order: a broadcast deals no row anew."""
        told = params.select(F.col("k").alias("_k"), *PARAMS)
        return self.rows.join(F.broadcast(told), F.col("k").eqNullSafe(F.col("_k"))).select("k", "t", "v", "_block", *PARAMS)

    def entries(self, joined: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, bool]]:
        """By block: the forward weights before its first row, the backward weights after its last, and whether its first row begins a key."""
        kind = self.kinds["k"]
        declared = f"_block int, first {kind}, last {kind}, one boolean, " + ", ".join(f"{n}{i} double" for n in ("head", "total") for i in range(4))
        schema = _arrow_schema(self.spark, declared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if (got := _read(batches)) is None:
                return
            block, x, p, new = got
            maps = _maps(_likely(x, p), _moves(p))
            at = np.flatnonzero(new)
            head = product(Weights, maps[: at[0]] if len(at) else maps)
            if len(at):  # only the last key's rows reach the end
                tail = maps[at[-1] :].copy()
                tail[:1] = Weights.compose(tail[:1], Weights.reset(HALF[None]))
                total = product(Weights, tail)
            else:
                total = head
            values = [block.column(3)[0].as_py(), _key(block, 0, 1)[0], _key(block, block.num_rows - 1, 1)[0], not len(at), *head.tolist(), *total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        found = sorted(joined.mapInArrow(run, declared).collect(), key=lambda r: r["_block"])  # one row a block
        out, state, last = {}, HALF, object()
        for r in found:
            begins = r["first"] != last
            state = HALF if begins else state
            out[r["_block"]] = [state, HALF, begins]
            state = Weights.apply(np.array([r[f"total{i}"] for i in range(4)]), state)
            last = r["last"]
        after, first = HALF, object()
        for r in reversed(found):
            out[r["_block"]][1] = after = after if r["last"] == first else HALF
            if not r["one"]:  # what this block says of its first key, whose end lies in it
                after = HALF
            head = np.array([r[f"head{i}"] for i in range(4)])[[0, 2, 1, 3]]
            after, first = Weights.apply(head, after), r["first"]
        return {b: tuple(v) for b, v in out.items()}


def smoothed(df: DataFrame, calm: tuple[float, float], wild: tuple[float, float], stay: tuple[float, float], value: str = "ret", order: str = "ts", keys: str = "ticker", blocks: int | None = None) -> DataFrame:
    """(keys, order, wild): the probability of the second regime given all rows of the series, those after it too; parameters and nulls as ``models.regime_filter`` has them."""
    if not all(0 < q < 1 for q in stay):
        raise ValueError("a regime stays with a probability between 0 and 1")
    held = _Blocks(df, value, order, keys, blocks)
    numbers = dict(zip(PARAMS, (*calm, *wild, *stay)))
    joined = held.rows.select("k", "t", "v", "_block", *(F.lit(float(x)).alias(c) for c, x in numbers.items()))
    entries = held.entries(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _read(batches)) is not None:
            _, done, beyond, *_ = _smooth(*got, entries)
            both = done * beyond
            yield pa.RecordBatch.from_arrays([got[0].column(0), got[0].column(1), pa.array(both[:, 1] / both.sum(axis=1))], [keys, order, "wild"])

    return joined.mapInArrow(run, f"`{keys}` {held.kinds['k']}, `{order}` {held.kinds['t']}, wild double")


def fit(df: DataFrame, value: str = "ret", order: str = "ts", keys: str = "ticker", rounds: int = 25, rest: float = 1e-6, blocks: int | None = None) -> DataFrame:
    """(keys, n, PARAMS, loglik): parameters after ``rounds`` of expectation-maximisation, or once no series gains ``rest`` of its likelihood's logarithm; loglik has that logarithm before each round.

    It starts from the series' mean and from 0.6 and 1.6 of its deviation.  The regime of less deviation
    is called calm.  Rows without a value do not count; keys of under 4 values, or of equal ones, are left out.  A regime's
    variance is held above FLOOR of the series' own.  Keys' parameters are broadcast: more than
    MOST_BROADCAST keys raise, to be fitted in parts.
    """
    told = df.filter(F.col(value).isNotNull())
    moments = checkpoint(told.groupBy(F.col(keys).alias("k")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).filter("n >= 4 and std > 0"))
    if moments.count() > MOST_BROADCAST:
        raise ValueError(f"more than {MOST_BROADCAST} keys: fit them in parts")
    held = _Blocks(told, value, order, keys, blocks)
    params = moments.select(
        "k", "n", F.col("mean").alias("calm_mean"), (F.col("std") * 0.6).alias("calm_std"), F.col("mean").alias("wild_mean"), (F.col("std") * 1.6).alias("wild_std"),
        F.lit(0.95).alias("calm_stay"), F.lit(0.9).alias("wild_stay"), (F.col("std") * F.col("std") * FLOOR).alias("least"), F.array().cast("array<double>").alias("loglik"),
    )
    for _ in range(rounds):
        params = written(_maximised(params, _expected(held, params)))
        gain = F.col("loglik")[F.size("loglik") - 1] - F.get("loglik", F.size("loglik") - 2)
        if params.filter(F.coalesce(gain > rest * F.abs(F.col("loglik")[F.size("loglik") - 1]), F.lit(True))).isEmpty():
            break
    swap = F.col("calm_std") > F.col("wild_std")
    other = {c: ("wild" if c.startswith("calm") else "calm") + c[4:] for c in PARAMS}
    return params.select(F.col("k").alias(keys), "n", *(F.when(swap, F.col(other[c])).otherwise(F.col(c)).alias(c) for c in PARAMS), "loglik")


def _expected(held: _Blocks, params: DataFrame) -> DataFrame:
    """(k, SUMS): expected counts of each key under its parameters."""
    joined = held.with_params(params)
    entries = held.entries(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _read(batches)) is None:
            return
        block, x, p, _ = got
        before, done, beyond, d, t, new = _smooth(*got, entries)
        weight = done * beyond
        weight /= weight.sum(axis=1, keepdims=True)
        away = x[:, None] - p[:, [0, 2]]
        moves = before[:, [0, 0, 1, 1]] * t * (d * beyond)[:, [0, 1, 0, 1]]
        moves /= moves.sum(axis=1, keepdims=True)
        seen = ((before[:, [0, 0, 1, 1]] * t).reshape(-1, 2, 2).sum(axis=1) * d).sum(axis=1)
        cells = np.column_stack([weight, weight * away, weight * away * away, moves, np.log(seen)])
        at = np.unique(np.append(np.flatnonzero(new), 0))
        sums = np.add.reduceat(cells, at, axis=0)
        yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(at)), *(pa.array(sums[:, i]) for i in range(len(SUMS)))], ["k", *SUMS])

    made = joined.mapInArrow(run, f"k {held.kinds['k']}, " + ", ".join(f"{c} double" for c in SUMS))
    return made.groupBy("k").agg(*(F.sum(c).alias(c) for c in SUMS))


def _maximised(params: DataFrame, sums: DataFrame) -> DataFrame:
    renamed = sums.select(F.col("k").alias("_k"), *(F.col(c).alias(f"_{c}") for c in SUMS))
    joined = params.join(F.broadcast(renamed), F.col("k").eqNullSafe(F.col("_k")))

    def mean(regime: str, i: int) -> Column:
        return F.when(F.col(f"_n{i}") > 0, F.col(f"{regime}_mean") + F.col(f"_s{i}") / F.col(f"_n{i}")).otherwise(F.col(f"{regime}_mean")).alias(f"{regime}_mean")

    def std(regime: str, i: int) -> Column:
        shift = F.col(f"_s{i}") / F.col(f"_n{i}")
        var = F.greatest(F.col(f"_q{i}") / F.col(f"_n{i}") - shift * shift, F.col("least"))
        return F.when(F.col(f"_n{i}") > 0, F.sqrt(var)).otherwise(F.col(f"{regime}_std")).alias(f"{regime}_std")

    def stay(regime: str, i: int) -> Column:
        all_moves = F.col(f"_m{i}0") + F.col(f"_m{i}1")
        made = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col(f"_m{i}{i}") / all_moves))
        return F.when(all_moves > 0, made).otherwise(F.col(f"{regime}_stay")).alias(f"{regime}_stay")

    return joined.select("k", "n", mean("calm", 0), std("calm", 0), mean("wild", 1), std("wild", 1), stay("calm", 0), stay("wild", 1), "least", F.concat("loglik", F.array("_loglik")).alias("loglik"))
