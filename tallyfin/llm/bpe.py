"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each merge rank has a bucket of linked-list positions.  A three-level bitmap of 64-bit words marks
the non-empty buckets; find-first-set on each level gives the smallest rank in three steps.
Positions whose pair has changed since they were queued are skipped when they come up.  Cost per
pre-token is linear in its length but for the bucket's own order, so very long pre-tokens are safe.

The rank file is read once on the driver and broadcast: it is a fixed vocabulary (under 1 MB).
No row meets another, so there is no shuffle, and a hot source or group of copies changes nothing.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import PIECE_BYTES

#: Pre-tokens in each of the two generations that a Python worker remembers; the older one goes when the newer is full.
REMEMBERED = 350_000
#: Longer pre-tokens are encoded each time.
REMEMBERED_CHARS = 48
#: Classes of the pattern as they are in Latin-1, the longer ones first.
LATIN = {
    r"[^\s\p{L}\p{N}]": "[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]", r"\p{L}": "[A-Za-zªµºÀ-ÖØ-öø-ÿ]", r"\p{N}": "[0-9²³¹¼½¾]",
    r"\s": "[\t-\r \x85\xa0]", r"\S": "[^\t-\r \x85\xa0]",
}


def read_ranks(path: str) -> dict[bytes, int]:
    """{token bytes: rank} of a file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


class Codec:
    """Encodes and decodes by ranks; pre-tokens by a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.pattern = regex.compile(pattern)
        # the same classes spelled out for texts of Latin-1 alone, where the standard library's matcher is faster
        plain = pattern
        for long, short in LATIN.items():
            plain = plain.replace(long, short)
        self.latin = re.compile(plain) if "\\" not in plain else None
        # the rank queue: two lower bitmap levels (the top one is a number) and the buckets; empty again after each pre-token
        self.low, self.mid = [0] * ((self.size >> 6) + 1), [0] * ((self.size >> 12) + 1)
        self.buckets: dict[int, list[int]] = {}
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        codec = self

        class Memory(dict):
            older: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                ids = self.older.get(piece)
                if ids is None:
                    ids = array("i", codec.encode_piece(piece.encode())).tobytes()
                if len(piece) <= REMEMBERED_CHARS:
                    if len(self) >= REMEMBERED:
                        self.older = dict(self)
                        self.clear()
                    self[piece] = ids
                return ids

        self.memory = Memory()

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank merges first, the leftmost first of one rank."""
        ranks, n = self.ranks, len(piece)
        get, heappop, heappush = ranks.get, heapq.heappop, heapq.heappush
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        end = list(range(1, n + 1))  # the part at i is piece[i:end[i]]; the next part starts at end[i]
        before = list(range(-1, n - 1))
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that starts at i; -1: none, or the part is gone
        pair.append(-1)
        low, mid, buckets, top = self.low, self.mid, self.buckets, 0
        for i, r in enumerate(pair):
            if r >= 0:
                if (bucket := buckets.get(r)) is not None:
                    bucket.append(i)  # places rise, so it stays a heap
                else:
                    buckets[r] = [i]
                    low[r >> 6] |= 1 << (r & 63)
                    mid[r >> 12] |= 1 << ((r >> 6) & 63)
                    top |= 1 << (r >> 12)
        while top:
            # find-first-set, level by level
            a = (top & -top).bit_length() - 1
            b = (a << 6) | ((mid[a] & -mid[a]).bit_length() - 1)
            rank = (b << 6) | ((low[b] & -low[b]).bit_length() - 1)
            bucket = buckets[rank]
            while bucket:
                i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
                if pair[i] != rank:
                    continue  # stale
                j = end[i]
                pair[j] = -1
                k = end[i] = end[j]
                p, lower = before[i], False
                if k < n:
                    before[k] = i
                    right = get(piece[i : end[k]], -1)
                else:
                    right = -1
                pair[i] = right
                left = get(piece[p:k], -1) if p >= 0 else -1
                for r, at in ((left, p), (right, i)):
                    if r >= 0:
                        if at == p:
                            if pair[p] == r:
                                continue
                            pair[p] = r
                        if (other := buckets.get(r)) is not None:
                            heappush(other, at)
                        else:
                            buckets[r] = [at]
                            low[r >> 6] |= 1 << (r & 63)
                            mid[r >> 12] |= 1 << ((r >> 6) & 63)
                            top |= 1 << (r >> 12)
                        lower = lower or r < rank
                    elif at == p and p >= 0:
                        pair[p] = -1
                if lower:
                    break
            if not bucket:
                del buckets[rank]
                low[b] ^= 1 << (rank & 63)
                if not low[b]:
                    mid[a] ^= 1 << (b & 63)
                    if not mid[a]:
                        top ^= 1 << a
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def pieces(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin.findall(text)
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.pieces(text))), np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, as uint8."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)]


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids array<int> (special tokens' strings are plain text), decoded binary (the ids decoded again).

    Null text counts as empty and gives no ids.  Every row is kept, repeated ones too; null ids stay null.
    Whole texts are encoded, however long.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                encoded, size, start = [], 0, at
                while at < len(texts) and size < PIECE_BYTES:
                    text = texts[at].as_py() or ""
                    encoded.append(codec.encode(text))
                    size += len(text)
                    at += 1
                flat = np.concatenate(encoded)
                counts = np.array([0, *map(len, encoded)])
                offsets = np.cumsum(counts).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(codec.lengths[flat])])[offsets]
                out = codec.decode(flat)
                decoded = pa.Array.from_buffers(pa.binary(), len(encoded), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([ids.slice(start, at - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], ["doc_id", "ids", "decoded"])

    cols = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
