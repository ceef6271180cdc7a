"""Shared helpers: Arrow batches of text cut into bounded pieces, word and shingle hashes, checkpoints.

Word hashing is vectorised over the bytes of many texts at once: a prefix sum of ``byte * B**i``
(mod 2**64, B odd and so invertible) gives every word's polynomial hash by one subtraction and one
multiplication, without a Python step per word.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer single text makes a pass of its own.
PIECE_BYTES = 1 << 20

#: Share of all rows from which a key counts as hot, and rows that are never too many for a task.
HOT, HOT_ROWS = 10_000, 1000
#: Rows of a few dozen bytes that are broadcast at most.
MOST_BROADCAST = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII white space: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only a local master without it (as in tests) gets a folder of this session's own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyfin-ckpt-"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with the other columns of their key in ``keyed`` (one row a key, with its number of rows as n; n is left out).

    Keys with more than one in HOT of all ``total`` rows (and HOT_ROWS at least) are at most HOT and go
    by broadcast; the rest is joined by a shuffle in which no key is more than that share of the rows.
    """
    hot_from = max(HOT_ROWS, total // HOT)
    hot = F.broadcast(keyed.filter(F.col("n") > hot_from).drop("n"))
    cold = keyed.filter(F.col("n") <= hot_from).drop("n")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has at most MOST_BROADCAST rows; it is counted, so it should be a checkpoint."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], wide, n + 1, column.offset * wide().itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words begin among them (one more for the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = fold[data]
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] |= inside[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _M1)
    return h, np.searchsorted(s, offsets)


def join_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (of any text)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h *= _M2
        h += words[j : j + n]
    return mix(h + np.uint64(k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; of fewer words, one for the whole sequence; without words, none."""
    words, at = word_hashes(data, offsets)
    every = join_hashes(words, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield join_hashes(words[a:b], b - a)
        else:
            yield every[:0]


def clean_ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what an operator needs, under names of its own, so that further columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
