"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch (``sketch``): in round i every element is placed in a hashed bin with value (i, hash) and each
of the T bins keeps its least value; rounds stop once all bins are full, and from round T on round
T + j fills bin j with all elements, so every coordinate is surely filled.  Two sets agree on a
coordinate with probability equal to their Jaccard similarity, and the sketch concentrates like T
independent minima.

Search: documents with equal sets first become one class (its least id stands for it).  BANDS bands
of ROWS coordinates give bucket keys; a pair at similarity 0.8 shares no bucket with probability
(1 - 0.8**4)**32 < 5e-8.  No bucket is expanded into its pairs: each member meets the bucket's least
one, and the components of these edges are candidate clusters that hold every candidate pair.

Verification: a cluster is dealt into blocks of bounded weight (shingles and documents), by the least
band key of a document, which near copies tend to share.  Each block, and each pair of blocks that
share a bucket, compares all its documents on their full sets at once: shared shingles are counted by a
matrix product for frequent shingles and by their few pairs for rare ones.  A pair of blocks returns
a spanning forest of its links, never all of them.  Components of the links are the groups.  So the
result is exact on every candidate pair, with no cap, and a group of thousands of copies costs one or
a few blocks.  A bucket that b blocks of one cluster share still costs b * (b - 1) / 2 comparisons.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import checkpoint, clean_ids, join_counted, mix, shingle_sets, small, text_pieces
from tallyfin.llm.graph import components

BINS, BANDS, ROWS = 128, 32, 4
_BIN_BITS = np.uint64(57)  # 7 bits of bin, 8 of round, 49 of hash
_ROUND_BITS = np.uint64(49)
#: Weight of a block (shingles, and DOC_WEIGHT for each document), and the most documents of a shingle that counts as rare.
BLOCK_WEIGHT, DOC_WEIGHT, RARE, COLUMNS = 1_000_000, 500, 8, 2048
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketch(elements: np.ndarray) -> np.ndarray:
    """T = 128 coordinates (uint64 of round and hash) of a non-empty set of 64-bit elements."""
    out = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    n, at = len(elements), 0
    while at < BINS and not filled.all():
        rounds = min(BINS - at, max(1, 1024 // n))
        h = mix(elements[None, :] ^ _SEEDS[at : at + rounds, None])
        bins = h >> _BIN_BITS
        values = (bins << _BIN_BITS) | (np.arange(at, at + rounds, dtype=np.uint64)[:, None] << _ROUND_BITS) | (h & np.uint64((1 << 49) - 1))
        values = np.sort(values.ravel())
        b = (values >> _BIN_BITS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        new = first[~filled[b[first]]]
        out[b[new]] = values[new] & np.uint64((1 << 57) - 1)
        filled[b[new]] = True
        at += rounds
    for j in np.flatnonzero(~filled):
        out[j] = np.uint64((BINS + j) << 49) | (mix(elements ^ _SEEDS[BINS + j]).min() & np.uint64((1 << 49) - 1))
    return mix(out)


def _band_keys(s: np.ndarray) -> np.ndarray:
    rows = s.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h ^ rows[:, j]) + np.uint64(j)
    return h


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_pieces(batch.column(1)):
                sizes, digests, keys = [], [], []
                for elements in shingle_sets(data, offsets, k):
                    sizes.append(len(elements))
                    digests.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None)
                    if len(elements):
                        keys.append(_band_keys(sketch(elements)).view(np.int64))
                    else:
                        keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "mark", "n_shingles", "digest", "keys"],
                )

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of all pairwise intersections."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    owner, times_of = owner[order], times[place[order]]
    out = np.zeros(n * n, np.int64)
    for f in range(2, RARE + 1):
        rows = owner[times_of == f].reshape(-1, f)
        if len(rows):
            i, j = np.triu_indices(f, 1)
            out += np.bincount((rows[:, i] * n + rows[:, j]).ravel(), minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    often = np.flatnonzero(times > RARE)
    column = np.full(len(times), -1)
    column[often] = np.arange(len(often))
    where = column[place[order]]
    held, where = owner[where >= 0], where[where >= 0]
    for at in range(0, len(often), COLUMNS):
        inside = (where >= at) & (where < at + COLUMNS)
        m = np.zeros((n, min(COLUMNS, len(often) - at)), np.float32)
        m[held[inside], where[inside] - at] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    return out


def spanning_links(ids: list[int], sides: list[int], sets: list[np.ndarray], across: bool, percent: int) -> tuple[list[int], list[int]]:
    """A forest of the links between these documents (only between the two sides, if ``across``)."""
    if len(ids) == 2:
        shared = len(sets[0]) + len(sets[1]) - len(np.union1d(*sets))
        ok = 100 * shared >= percent * (len(sets[0]) + len(sets[1]) - shared) and (not across or sides[0] != sides[1])
        return ([ids[0]], [ids[1]]) if ok else ([], [])
    shared = shared_counts(sets)
    sizes = np.array([len(x) for x in sets])
    near = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(near, False)
    if across:
        side = np.array(sides)
        near &= side[:, None] != side[None, :]
    a, b, left = [], [], np.ones(len(ids), bool)
    for root in range(len(ids)):
        if left[root]:
            left[root] = False
            front = [root]
            while front:
                x = front.pop()
                new = np.flatnonzero(near[x] & left)
                left[new] = False
                front += new.tolist()
                a += [ids[x]] * len(new)
                b += [ids[y] for y in new]
    return a, b


def _verify(k: int, percent: int):
    """Links of each (cluster, i, j), whose rows come together: (cluster, i, j, side, rep, text)."""

    def close(key: tuple, ids: list, sides: list, texts: list) -> pa.RecordBatch:
        a: list[int] = []
        b: list[int] = []
        if len(ids) > 1:
            sets = [x for *_, data, offsets in text_pieces(pa.array(texts, pa.large_string())) for x in shingle_sets(data, offsets, k)]
            a, b = spanning_links(ids, sides, sets, key[1] != key[2], percent)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, sides, texts = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            for key, side, rep, text in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                if key != last:
                    if last is not None:
                        yield close(last, ids, sides, texts)
                    last, ids, sides, texts = key, [], [], []
                ids.append(rep)
                sides.append(side)
                texts.append(text.as_py())
        if last is not None:
            yield close(last, ids, sides, texts)

    return run


def _blocks(classes: DataFrame) -> DataFrame:
    """classes (cluster, rep, mark, weight, keys) with their block ``at`` and the number of ``groups`` of their cluster.

    A cluster of more than BLOCK_WEIGHT is dealt by its classes' least band key, which near copies tend
    to share, and what is still too heavy by a hash.  There is at most one such cluster for each BLOCK_WEIGHT.
    """
    heavy = lambda df, keys, name: small(checkpoint(df.groupBy(*keys).agg(F.ceil(F.sum("weight") / BLOCK_WEIGHT).cast("long").alias(name)).filter(F.col(name) > 1)))
    grouped = classes.join(heavy(classes, ["cluster"], "groups"), "cluster", "left").fillna(1, ["groups"])
    grouped = grouped.withColumn("group", F.pmod(F.xxhash64(F.array_min("keys")), F.col("groups")))
    dealt = grouped.join(heavy(grouped.filter("groups > 1"), ["cluster", "group"], "parts"), ["cluster", "group"], "left").fillna(1, ["parts"])
    return dealt.withColumn("at", F.shiftleft("group", 24) + F.pmod(F.xxhash64("rep", "mark"), F.col("parts")))


def link_classes(sketches: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) over class representatives.  sketches: (rep, mark, n_shingles, keys), one row a class; docs: (rep, mark, text), whose rows may repeat.

    Two blocks of a cluster are compared only if they share a bucket.
    """
    keyed = sketches.select("rep", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("n")).filter(F.col("first") < F.col("last"))
    least = checkpoint(least.select("key", "first", "n"))
    shared = int(least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    stars = join_counted(keyed, least, ["key"], shared).filter(F.col("rep") > F.col("first")).select("rep", "first").distinct()
    clusters = components(stars, "rep", "first").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    classes = checkpoint(sketches.select("rep", "mark", (F.col("n_shingles") + DOC_WEIGHT).alias("weight"), "keys").join(clusters, "rep"))
    placed = checkpoint(_blocks(classes).select("cluster", "groups", "rep", "mark", "keys", "at"))
    inside = placed.select("cluster", F.col("at").alias("i"), F.col("at").alias("j"), F.lit(0).alias("side"), "rep", "mark")
    held = placed.filter("groups > 1").select("cluster", "at", F.explode("keys").alias("key")).groupBy("cluster", "key").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    pairs = F.flatten(F.transform("ats", lambda i, n: F.transform(F.slice("ats", n + 2, F.greatest(F.size("ats") - n - 1, F.lit(0))), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    pairs = held.filter(F.size("ats") > 1).select("cluster", F.explode(pairs).alias("p")).select("cluster", "p.i", "p.j").distinct()
    ends = pairs.select("cluster", F.col("i").alias("at"), "i", "j", F.lit(0).alias("side")).unionByName(pairs.select("cluster", F.col("j").alias("at"), "i", "j", F.lit(1).alias("side")))
    across = placed.join(ends, ["cluster", "at"]).select("cluster", "i", "j", "side", "rep", "mark")
    texts = docs.join(placed.select("rep", "mark"), ["rep", "mark"], "left_semi").groupBy("rep", "mark").agg(F.min("text").alias("text"))
    rows = inside.unionByName(across).join(texts, ["rep", "mark"]).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return rows.select("cluster", "i", "j", "side", "rep", "text").mapInArrow(_verify(k, percent), "a long, b long")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles long, component_id long, kept boolean.

    A text's set is its distinct k-word shingles (words: runs of other than ASCII white space, A-Z
    lower-cased; fewer than k words: all of them as one).  Texts are linked if 100 * intersection
    >= percent * union; component_id is the least doc_id reachable, kept is doc_id = component_id.
    Null, empty and wordless texts have no set and no link.  Repeated rows of one doc_id are one
    node with the links of each row's text.  A null doc_id gets null for component_id and kept.
    """
    docs = clean_ids(df, id_col, text_col).withColumn("mark", F.xxhash64("text"))  # tells repeated ids apart
    made = checkpoint(docs.mapInArrow(_sketches(k), "doc_id long, mark long, n_shingles long, digest binary, keys array<long>"))
    known = made.filter("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("head"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = checkpoint(classes.select(F.col("head.doc_id").alias("rep"), "head.mark", "digest", "n", "n_shingles", "keys"))
    total = made.count()
    member = join_counted(known.select("doc_id", "n_shingles", "digest"), classes.select("digest", "rep", "n"), ["digest"], total).drop("digest")
    member = checkpoint(member.unionByName(made.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))))
    texts = docs.join(classes.select(F.col("rep").alias("doc_id"), "mark"), ["doc_id", "mark"], "left_semi")
    links = link_classes(classes.select("rep", "mark", "n_shingles", "keys"), texts.select(F.col("doc_id").alias("rep"), "mark", "text"), k, percent)
    # a document of several classes links them
    owned = member.filter("doc_id is not null")
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).filter("low < high").select("doc_id", "n")
    links = links.unionByName(join_counted(owned, several, ["doc_id"], total).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    linked = components(links)
    counts = owned.groupBy("rep").agg(F.count("*").alias("n"))
    keyed = counts.join(linked, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component_id"), "n")
    out = join_counted(owned, checkpoint(keyed), ["rep"], total).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(member.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("boolean").alias("kept")))


#: All pairs that share a shingle, and all that each document reaches: for small tables.
ORACLE = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
),
shingles as (
  select distinct doc_id, array_to_string(w[p:p + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2)::bigint)) as p from words where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select x, y from (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all)
  join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)
),
reached as (select doc_id, doc_id as other from documents union select y, other from reached join pairs on doc_id = x),
parts as (select doc_id, min(other) as component_id from reached group by doc_id)
select parts.doc_id as doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, parts.doc_id = component_id as kept from parts left join sizes on parts.doc_id = sizes.doc_id
"""
