"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by set size in powers of two.  Each item is sketched by ``k`` independent
min-wise coordinates; a coordinate keeps the shingle that attains the minimum.  If a document holds
a share c of an item, each coordinate's minimal shingle is in it with probability c, whatever the
document's size, so the share of coordinates found estimates containment directly and long documents
do not dilute it.  A partition's sketch length and least count follow from its sizes so that an item
held to the threshold is missed with probability below 1e-9 (small items are sketched whole, and
then nothing is missed).  Candidates are confirmed on the item's and the document's full sets.

Items are broadcast in blocks of bounded bytes; a larger benchmark only takes more blocks.  Documents
are read and hashed once for PASS blocks, never shuffled, and a document's work depends on its own length:
its shingles are looked up in the blocks' sorted keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import clean_ids, join_hashes, mix, text_pieces, word_hashes

#: Text of the items in a broadcast block, and coordinates of a sketch.
BLOCK_BYTES = 16 << 20
#: Blocks that a worker holds, and so that one pass over the documents searches.
PASS = 4
COORDINATES = 48
MISS = 1e-9


def least_hits(k: int, threshold: float) -> int:
    """The largest count that k coordinates reach with probability over 1 - MISS at the threshold."""
    below, h = 0.0, 0
    while h < k and (below := below + comb(k, h) * threshold**h * (1 - threshold) ** (k - h)) < MISS:
        h += 1
    return max(1, h)


def sketch_items(item_ids: list[int], texts: list[str], k: int, threshold: float) -> dict:
    """Item sets, and by sketch shingle the items that keep it.  Items without words are left out."""
    sets, widths, keep, sketch_of, need = [], [], [], [], []
    for item, text in zip(item_ids, texts):
        data = np.frombuffer(text.encode(), np.uint8)
        words, _ = word_hashes(data, np.array([0, len(data)]))
        if not len(words):
            continue
        width = min(k, len(words))
        full = np.unique(join_hashes(words, width))
        partition = int(len(full) - 1).bit_length()  # sizes in (2**(p-1), 2**p]
        if 1 << partition <= COORDINATES:
            sketch, least = full, int(np.ceil(threshold * len(full) - 1e-9))
        else:
            seeds = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) + np.uint64(partition << 32))
            sketch = np.array([full[np.argmin(mix(full ^ seed))] for seed in seeds])
            least = least_hits(COORDINATES, threshold)
        keep.append(item)
        sets.append(full)
        widths.append(width)
        sketch_of.append(sketch)
        need.append(least)
    owners = np.repeat(np.arange(len(keep)), [len(s) for s in sketch_of]) if keep else np.zeros(0, np.int64)
    flat = np.concatenate(sketch_of) if keep else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    return {"ids": keep, "sets": sets, "widths": widths, "need": need, "keys": flat[order], "owners": owners[order]}


def _search(index: dict, words: np.ndarray, threshold: float, gates: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(item index, shared shingles, item shingles) for one document's word hashes."""
    hits: dict[int, int] = {}
    found: dict[int, np.ndarray] = {}
    for width, gate in gates.items():
        shingles = join_hashes(words, width)
        near = shingles[gate[(shingles >> np.uint64(44)).astype(np.int64)]]
        if not len(near):
            continue
        near = np.unique(near)
        low, high = np.searchsorted(index["keys"], near), np.searchsorted(index["keys"], near, side="right")
        n = high - low
        if not n.any():
            continue
        found[width] = np.unique(shingles)
        places = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owners, counts = np.unique(index["owners"][places], return_counts=True)
        for owner, count in zip(owners.tolist(), counts.tolist()):
            if index["widths"][owner] == width:
                hits[owner] = hits.get(owner, 0) + count
    for owner, count in hits.items():
        if count >= index["need"][owner]:
            full = index["sets"][owner]
            shared = int(np.isin(full, found[index["widths"][owner]], assume_unique=True).sum())
            if shared * 1000 >= round(threshold * 1000) * len(full):
                yield owner, shared, len(full)


def _gates(index: dict) -> dict[int, np.ndarray]:
    """By shingle width, a bitmap of the sketches' top 20 bits: most of a document's shingles end there."""
    gates = {}
    for width in sorted(set(index["widths"])):
        gate = np.zeros(1 << 20, bool)
        gate[(index["keys"] >> np.uint64(44)).astype(np.int64)] = True
        gates[width] = gate
    return gates


def _blocks(benchmark: DataFrame, k: int, threshold: float, item_id_col: str, item_text_col: str) -> Iterator[Broadcast]:
    """The benchmark's sketches, in broadcasts of at most about BLOCK_BYTES of text each."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = part.collect()  # bounded by BLOCK_BYTES
        yield benchmark.sparkSession.sparkContext.broadcast(sketch_items([r["item_id"] for r in rows], [r["text"] for r in rows], k, threshold))


def _passes(*args) -> Iterator[list[Broadcast]]:
    """The blocks, PASS at a time."""
    part: list[Broadcast] = []
    for shared in _blocks(*args):
        part.append(shared)
        if len(part) == PASS:
            yield part
            part = []
    if part:
        yield part


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no item to the threshold (see find_contamination); no shuffle."""
    text_at = docs.columns.index(text_col)
    for part in _passes(benchmark, k, threshold, item_id_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            indexes = [(shared.value, _gates(shared.value)) for shared in part]
            for batch in batches:
                clean: list[bool] = []
                for _, _, data, offsets in text_pieces(batch.column(text_at)):
                    words, at = word_hashes(data, offsets)
                    clean += [all(next(_search(index, words[a:b], threshold, gates), None) is None for index, gates in indexes) for a, b in zip(at[:-1], at[1:])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document that holds at least ``threshold`` of an item's distinct k-word shingles.

    Words are runs of other than ASCII white space with A-Z lower-cased.  An item of fewer than k
    words is one shingle of all its words.  Null, empty and wordless items or documents match nothing.
    Repeated document rows give repeated pairs; repeated items give a pair each.
    """
    out = None
    for share in _passes(benchmark, k, threshold, item_id_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            indexes = [(shared.value, _gates(shared.value)) for shared in share]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out: list[tuple] = []
                for first, end, data, offsets in text_pieces(batch.column(1)):
                    words, at = word_hashes(data, offsets)
                    for i in range(first, end):
                        for index, gates in indexes:
                            for owner, n, m in _search(index, words[at[i - first] : at[i - first + 1]], threshold, gates):
                                out.append((ids[i], index["ids"][owner], n, m, n / m))
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        part = clean_ids(docs, id_col, text_col).mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long, containment double")
        out = part if out is None else out.unionAll(part)
    return out


ORACLE = r"""
with words as (
  select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
  union all
  select 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') from benchmark
),
widths as (select distinct least(5, len(w)) as k from words where kind = 'i' and len(w) > 0),
shingles as (
  select distinct kind, id, k, array_to_string(w[p:p + k - 1], ' ') as s
  from (select kind, id, w, k, unnest(range(1, (len(w) - k + 2)::bigint)) as p from words, widths where len(w) >= k and (kind = 'd' or k = least(5, len(w))))
),
sizes as (select id, count(*) as n from shingles where kind = 'i' group by id),
pairs as (select d.id as doc_id, i.id as item_id, count(*) as n_shared from shingles i join shingles d on i.s = d.s and i.k = d.k and d.kind = 'd' where i.kind = 'i' group by all)
select doc_id, item_id, n_shared::bigint as n_shared, n::bigint as n_item, n_shared::double / n as containment
from pairs join sizes on item_id = sizes.id where n_shared * 1000 >= 800 * n
"""
