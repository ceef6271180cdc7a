"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking.

Vectors are dealt to bands of norm, BAND from end to end, and hashed by direction within their band:
there the largest inner products are the nearest directions but for that factor, and a band's hashes
do not depend on the norms of others.  Bands of few vectors are scanned whole.  A query skips the
bands whose norms are too small to reach the k-th of its scores with the GUIDES longest vectors, which
loses nothing.  In each band, each table keys a vector by several hashes floor((a.x + b) / width), a
normal.  A query does not visit its own bucket alone: the projections of a neighbour at cosine
``assumed`` are normal around the query's, which gives every perturbed bucket a success probability;
buckets are visited in falling order of it until they hold ``mass`` of it.  Table candidates are scored
exactly on the original vectors and merged.

The index is fitted (``fit``) on a bounded sample: SAMPLED queries, whose exact neighbours among all
vectors are found by a scan, say how far neighbours are (``assumed``) and how much mass finds the share
RECALL of them; SAMPLED_VECTORS vectors say how many such a search scores.  Of SHAPES the one of least
work is taken: clustered vectors get narrow buckets and few visits, vectors without any structure get
one table of wide ones.  Every vector is indexed.

Vectors and probes meet by (band and table, bucket, salt).  Only buckets of more than ROWS_PER_SALT
vectors have salts, by an exact count, so a probe is sent once but to those.  Equal vectors of a bucket
are collapsed to as many least ids as a query asks for first, which cannot lose a result.  A query that
found too few looks through all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfin.llm.common import checkpoint, mix


class Shape(NamedTuple):
    """Tables, functions of each, width of a bucket, and cells to either side of a neighbour's expected one that may be visited."""

    tables: int
    functions: int
    width: float
    reach: int


SHAPES = (Shape(1, 3, 1.0, 3), Shape(2, 3, 1.0, 3), Shape(6, 3, 1.0, 3), Shape(2, 5, 1.5, 2), Shape(4, 4, 1.5, 2), Shape(2, 8, 2.0, 1), Shape(4, 6, 2.0, 1))
#: Sizes of the samples, the share of the sampled neighbours that the visited buckets hold, and what a visit and a vector dealt to a table cost in scored vectors.
SAMPLED, SAMPLED_VECTORS, RECALL, VISIT, DEALT = 64, 4096, 0.94, 100, 50
#: Ratio of the norms in a band, most vectors of a band that is scanned whole, queries that scan one copy of it, and vectors that bound a query's scores from below.
BAND, SCANNED, QUERIES_PER_COPY, GUIDES = 1.25, 256, 4096, 512
#: Vectors of a bucket from which it is split by salts, and tables at most (numbers of bands and tables are told apart by it).
ROWS_PER_SALT, MOST_TABLES = 20_000, 8


class Hashes:
    """The hash functions of a shape for directions of d components, and the order in which buckets are visited."""

    def __init__(self, d: int, shape: Shape, assumed: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shape, self.assumed = shape, assumed
        self.a = rng.normal(size=(shape.tables, d, shape.functions))
        self.b = rng.uniform(0, shape.width, size=(shape.tables, shape.functions))
        self.offsets = np.array(list(product(range(-shape.reach, shape.reach + 1), repeat=shape.functions)))

    def cells(self, x: np.ndarray, t: int) -> np.ndarray:
        return np.floor((x @ self.a[t] + self.b[t]) / self.shape.width).astype(np.int64)

    def order(self, q: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query direction: its neighbours' expected cell, the offsets' order of visit, and the mass visited before each in that order."""
        w, reach = self.shape.width, self.shape.reach
        place = self.assumed * (q @ self.a[t]) + self.b[t]
        cell = np.floor(place / w).astype(np.int64)
        edges = (cell[:, :, None] + np.arange(-reach, reach + 2)) * w
        p = np.diff(_normal_cdf((edges - place[:, :, None]) / np.sqrt(1 - self.assumed**2)), axis=2)  # (rows, functions, offsets)
        chance = np.ones((len(q), len(self.offsets)))
        for j in range(self.shape.functions):
            chance *= p[:, j, self.offsets[:, j] + reach]
        order = np.argsort(-chance, axis=1, kind="stable")
        chance = np.take_along_axis(chance, order, 1)
        return cell, order, np.cumsum(chance, 1) - chance

    def before(self, q: np.ndarray, x: np.ndarray, t: int) -> np.ndarray:
        """(queries, vectors): the mass that each query visits before a vector's bucket; infinite beyond its reach.  x: one set for all queries, or one for each."""
        cell, order, before = self.order(q, t)
        by_offset = np.empty_like(before)
        np.put_along_axis(by_offset, order, before, 1)
        side = 2 * self.shape.reach + 1
        out = np.full((len(q), x.shape[-2]), np.inf)
        for i in range(len(q)):
            apart = self.cells(x[i] if x.ndim == 3 else x, t) - cell[i] + self.shape.reach
            inside = ((apart >= 0) & (apart < side)).all(1)
            out[i, inside] = by_offset[i, apart[inside] @ side ** np.arange(self.shape.functions - 1, -1, -1)]
        return out


class Fit(NamedTuple):
    """What ``fit`` chose; share: vectors scored a query, of all; visits: buckets visited a query."""

    shape: Shape
    assumed: float
    mass: float
    share: float
    visits: float


def fit(q: np.ndarray, near: list[np.ndarray], sample: np.ndarray, n: int, asked: int, recall: float = RECALL) -> Fit:
    """The shape of least work that finds the share ``recall`` of the sampled queries' neighbours.  q, near, sample: directions of queries, of each one's neighbours, and of vectors; n, asked: vectors and queries in all."""
    if not len(q) or not any(map(len, near)):
        return Fit(SHAPES[0], 0.5, 1.0, 1.0, 0.0)
    cosines = np.concatenate([y @ x for x, y in zip(q, near)])
    assumed = float(np.clip(np.median(cosines), 0.05, 0.98))
    best = None
    for shape in SHAPES:
        hashes = Hashes(q.shape[1], shape, assumed)
        need = [np.min([hashes.before(x[None], y, t)[0] for t in range(shape.tables)], 0) for x, y in zip(q, near) if len(y)]
        mass = float(np.quantile(np.concatenate(need), recall, method="higher"))
        if not np.isfinite(mass):
            continue
        mass = min(1.0, mass + 1e-12)
        share = sum(float((hashes.before(q, sample, t) < mass).mean()) for t in range(shape.tables))
        visits = sum(float((hashes.order(q, t)[2] < mass).sum(1).mean()) for t in range(shape.tables))
        work = share * n + VISIT * visits + DEALT * shape.tables * n / max(1, asked)
        if best is None or work < best[0]:
            best = (work, Fit(shape, assumed, mass, share, visits))
    return best[1] if best else Fit(SHAPES[0], assumed, 1.0, 1.0, float(len(Hashes(q.shape[1], SHAPES[0], assumed).offsets)))


class Tables:
    """The fitted hashes, with the bands of norm and the guides (ids, vectors) of a search for k; salts: by (band and table, bucket) of heavy buckets, how many."""

    def __init__(self, d: int, fitted: Fit, bands: dict[int, int], queries: int, guides: tuple[np.ndarray, np.ndarray], k: int):
        self.hashes, self.mass = Hashes(d, fitted.shape, fitted.assumed), fitted.mass
        self.bands, self.guides, self.k = bands, guides, k
        self.copies = max(1, -(-queries // QUERIES_PER_COPY))
        self.salts: dict[tuple[int, int], int] = {}

    def deal(self, x: np.ndarray, band: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(rows, table, their buckets) of vectors."""
        whole = np.isin(band, [b for b, n in self.bands.items() if n <= SCANNED])
        if whole.any():
            for copy in range(self.copies):
                yield np.flatnonzero(whole), 0, np.full(int(whole.sum()), copy)
        rows = np.flatnonzero(~whole)
        x = _directions(x[rows])
        for t in range(self.hashes.shape.tables):
            yield rows, t, _number(self.hashes.cells(x, t))

    def probes(self, ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each band and table, (band, table, query row, bucket) of the buckets to visit."""
        q = _directions(q)
        least = self._least(ids, q)
        reach = {b: np.exp((b + 0.5) * np.log(BAND)) * (1 + 1e-9) >= least for b in self.bands}
        for band, n in self.bands.items():
            if n <= SCANNED:
                row = np.flatnonzero(reach[band])
                yield band, 0, row, (mix(ids[row].astype(np.uint64)) % np.uint64(self.copies)).astype(np.int64)
        for t in range(self.hashes.shape.tables):
            cell, order, before = self.hashes.order(q, t)
            row, col = np.nonzero(before < self.mass)
            bucket = _number(cell[row] + self.hashes.offsets[order[row, col]])
            for band, n in self.bands.items():
                if n > SCANNED:
                    taken = reach[band][row]
                    yield band, t, row[taken], bucket[taken]

    def _least(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each query direction, a score that k vectors of other ids reach, or minus infinity."""
        guide_ids, guides = self.guides
        if len(guide_ids) <= self.k:
            return np.full(len(q), -np.inf)
        scores = np.where(ids[:, None] == guide_ids, -np.inf, q @ guides.T)
        return np.nan_to_num(np.partition(scores, -self.k, axis=1)[:, -self.k], nan=-np.inf, posinf=-np.inf, neginf=-np.inf)

    def spread(self, t: int, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, salt): each probe once, or once for each salt of a heavy bucket."""
        if not self.salts:
            return np.arange(len(bucket)), np.zeros(len(bucket), np.int32)
        n = np.array([self.salts.get((t, b), 1) for b in bucket.tolist()], np.int64)
        return np.repeat(np.arange(len(bucket)), n), (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)

    def salt(self, t: int, bucket: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if not self.salts:
            return np.zeros(len(bucket), np.int32)
        n = np.array([self.salts.get((t, b), 1) for b in bucket.tolist()], np.uint64)
        return (mix(ids.astype(np.uint64)) % n).astype(np.int32)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """By the logistic approximation (error under 1e-3, ample for an order of visits)."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.07056 * z**3, -60, 60)))


def _directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _number(cells: np.ndarray) -> np.ndarray:
    """One number for a bucket's cells; should two buckets share one, they are scored together."""
    out = np.zeros(len(cells), np.uint64)
    for j in range(cells.shape[1]):
        out = mix(out ^ cells[:, j].view(np.uint64)) + np.uint64(j)
    return out.view(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def nearest_in(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest of each query among these vectors, but for its own id; ties to the smaller id."""
    order = np.lexsort((ids, *x.T[:4]))
    ids, x = ids[order], x[order]
    if len(ids) > k + 1:  # of equal vectors the k + 1 least ids suffice
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        keep = np.arange(len(ids)) - first <= k
        ids, x = ids[keep], x[keep]
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ x.T
        n = min(k + 1, len(ids))
        least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n] - 1e-9 * max(1.0, float(np.abs(scores).max()))
        for i, row in enumerate(scores):
            near = np.flatnonzero(row >= least[i])
            near = near[ids[near] != query_ids[at + i]]
            exact = np.einsum("ij,j->i", x[near], q[at + i], optimize=False)
            best = np.lexsort((ids[near], -exact))[:k]
            out_q += [int(query_ids[at + i])] * len(best)
            out_v += ids[near][best].tolist()
            out_s += exact[best].tolist()
    return out_q, out_v, out_s


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _banded(rows: DataFrame) -> DataFrame:
    """Adds the logarithm of the norm, and the number of its band; norms of 1 are amid theirs, so that rounding does not part them."""
    most = rows.withColumn("most", F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most")))
    long = most.withColumn("log_norm", F.log("most") + 0.5 * F.log(square))
    return long.withColumn("band", F.round(F.col("log_norm") / float(np.log(BAND))).cast("int")).drop("most")


_SCORED = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _scored(d: int, k: int):
    """The k nearest in a group of vectors (vec_id, v) of each query (query_id, q) that comes to it."""

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _SCORED.empty_table()
        found = nearest_in(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v"), d), queries.column("query_id").to_numpy(), _matrix(queries.column("q"), d), k)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(found, _SCORED)], schema=_SCORED)

    return meet


def _dealt(rows: DataFrame, tables, d: int, carry: bool) -> DataFrame:
    """(t, bucket, salt) of each vector in each table of its band; with ``carry`` also vec_id and v."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, band = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for row, t, bucket in tables.value.deal(_matrix(batch.column(1), d), band):
                    taken, number = pa.array(row), band[row].astype(np.int64) * MOST_TABLES + t
                    salt = np.zeros(len(row), np.int32)
                    for one in np.unique(number).tolist():
                        here = number == one
                        salt[here] = tables.value.salt(one, bucket[here], ids[row[here]])
                    more = [batch.column(0).take(taken), batch.column(1).take(taken)] if carry else []
                    yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(bucket), pa.array(salt), *more], ["t", "bucket", "salt", "vec_id", "v"][: 3 + len(more)])

    return rows.select("vec_id", "v", "band").mapInArrow(deal, "t int, bucket long, salt int" + (", vec_id long, v array<double>" if carry else ""))


def _probes(queries: DataFrame, tables, d: int, carry: bool) -> DataFrame:
    """(t, bucket, salt, query_id) of each visit; with ``carry`` also q."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for band, t, row, bucket in tables.value.probes(part.column(0).to_numpy(), _matrix(part.column(1), d)):
                    number = band * MOST_TABLES + t
                    again, salt = tables.value.spread(number, bucket)
                    taken = pa.array(row[again])
                    more = [part.column(1).take(taken)] if carry else []
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(again), number, np.int32)), pa.array(bucket[again]), pa.array(salt), part.column(0).take(taken), *more], ["t", "bucket", "salt", "query_id", "q"][: 4 + len(more)])

    return queries.select("vec_id", "v").mapInArrow(probe, "t int, bucket long, salt int, query_id long" + (", q array<double>" if carry else ""))


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _true_neighbours(rows: DataFrame, ids: np.ndarray, q: np.ndarray, d: int, k: int) -> DataFrame:
    """(query_id, vec_id, v) of the k nearest of these few queries, by a scan of all rows; a batch sends k a query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                scores = np.where(ids[:, None] == own, -np.inf, q @ _matrix(batch.column(1), d).T)
                n = min(k, len(own))
                near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                taken = pa.array(near.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(np.take_along_axis(scores, near, 1).ravel())], ["query_id", "vec_id", "v", "score"])

    found = rows.select("vec_id", "v").mapInArrow(scan, "query_id long, vec_id long, v array<double>, score double").filter(F.col("score") > float("-inf"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "v")


def _sampled(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the n rows whose ids hash least (of one id, one)."""
    found = {r["vec_id"]: r["v"] for r in rows.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(n).collect()}
    return np.array(list(found), np.int64), np.array(list(found.values()), np.float64)


class Search:
    """What a search needs: usable rows by band, queries, and the fitted tables (broadcast); None for rows without any usable vector."""

    def __init__(self, df: DataFrame, every: int, k: int, id_col: str, vector_col: str, recall: float):
        rows = _usable(df, id_col, vector_col)
        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"))
        top = sizes.orderBy(F.desc("n"), "d").first()
        self.rows = self.queries = self.tables = None
        if top is None:
            return
        self.d, self.n, self.ids = top["d"], top["n"], top["ids"]
        self.rows = _banded(rows.filter(F.size("v") == self.d))
        asked = F.col("vec_id") % every == 0
        self.queries = self.rows.filter(asked)
        bands = self.rows.groupBy("band").agg(F.count("*").alias("n"), F.count_if(asked).alias("asked")).collect()
        self.asked = sum(r["asked"] for r in bands)
        longest = {r["vec_id"]: r["v"] for r in self.rows.orderBy(F.desc("log_norm"), "vec_id").select("vec_id", "v").limit(GUIDES).collect()}
        guides = np.array(list(longest), np.int64), np.array(list(longest.values()), np.float64)
        self.fitted = self._fit(k, recall) if any(r["n"] > SCANNED for r in bands) and self.asked else fit(np.zeros((0, self.d)), [], np.zeros((0, self.d)), self.n, 0)
        tables = Tables(self.d, self.fitted, {r["band"]: r["n"] for r in bands}, self.asked, guides, k)
        share = df.sparkSession.sparkContext.broadcast
        self.tables = share(tables)
        if self.n > ROWS_PER_SALT:  # fewer cannot make a bucket heavy
            heavy = _dealt(self.rows, self.tables, self.d, False).groupBy("t", "bucket").count().filter(F.col("count") > ROWS_PER_SALT)
            tables.salts = {(r["t"], r["bucket"]): -(-r["count"] // ROWS_PER_SALT) for r in heavy.collect()}  # at most one row a table for each ROWS_PER_SALT vectors
            self.tables = share(tables)

    def _fit(self, k: int, recall: float) -> Fit:
        ids, q = _sampled(self.queries, SAMPLED)
        near: dict[int, list] = {i: [] for i in ids.tolist()}
        for r in _true_neighbours(self.rows, ids, q, self.d, k).collect():  # SAMPLED times k rows
            near[r["query_id"]].append(r["v"])
        # neighbours of a norm far below the longest are found in their own band, so directions alone count
        directions = [_directions(np.array(near[i], np.float64)) if near[i] else np.zeros((0, self.d)) for i in ids.tolist()]
        return fit(_directions(q), directions, _directions(_sampled(self.rows, SAMPLED_VECTORS)[1]), self.n, self.asked, recall)


def scored_share(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> float:
    """Inner products that a search computes, of those of a scan: each vector counts as often as a query's tables meet it.  Exact, from counts of buckets and visits."""
    search = Search(df, every, k, id_col, vector_col, recall)
    if search.rows is None or not search.asked:
        return 0.0
    keys = ["t", "bucket", "salt"]
    held = _dealt(search.rows, search.tables, search.d, False).groupBy(*keys).agg(F.count("*").alias("n"))
    asked = _probes(search.queries, search.tables, search.d, False).groupBy(*keys).agg(F.count("*").alias("m"))
    met = held.join(asked, keys).agg(F.sum(F.col("n") * F.col("m")).alias("s")).first()["s"] or 0
    return met / (search.n * search.asked)


def nearest_neighbours(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k rows of largest inner product that were found, but for itself.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
    another length than most have, nor null ids.  Ties go to the smaller id.  Rows of one repeated id count once
    in a result (with their best score), and a query of a repeated id is searched with each of its vectors.
    """
    search = Search(df, every, k, id_col, vector_col, recall)
    if search.rows is None:
        rows = _usable(df, id_col, vector_col)
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    keys = ("t", "bucket", "salt")
    dealt, probes = _dealt(search.rows, search.tables, search.d, True), _probes(search.queries, search.tables, search.d, True)
    met = dealt.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(_scored(search.d, k), "query_id long, vec_id long, score double")
    found = checkpoint(_best(met, k))
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, search.ids - 1))
    lacking = search.queries.join(enough, search.queries["vec_id"] == enough["query_id"], "left_anti")
    if lacking.isEmpty():
        return found
    return _best(found.select("query_id", "vec_id", "score").unionAll(_exhaust(search.rows, lacking, search.d, max(8, -(-search.n // ROWS_PER_SALT)), k)), k)


def _exhaust(rows: DataFrame, lacking: DataFrame, d: int, salts: int, k: int) -> DataFrame:
    """The k nearest in each salt's share of all rows, for queries that found too few."""
    salted = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("salt"), "vec_id", "v")
    asked = lacking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return salted.groupBy("salt").cogroup(asked.groupBy("salt")).applyInArrow(_scored(d, k), "query_id long, vec_id long, score double")
