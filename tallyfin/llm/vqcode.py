"""Vector code compression: every part of an integer vector becomes the index of its nearest codebook entry, exactly.

Screening is a float32 matrix product: |c|^2 - 2 x.c of all entries at once.  Each value comes with a
rigorous bound of its rounding error, so the nearest entry is surely among those whose interval
reaches below the least upper end; only these are told apart, in int64, ties to the lower index.
Codebooks are a few thousand integers whatever the table's size; a round is one pass over the
vectors whose tasks return a sum and count an entry, so nothing else is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import checkpoint, join_counted

#: Parts of a vector, entries of a codebook, rounds of fitting, factor of the integers.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers are held within 2**27 on either side, so that distances and their sums stay within int64.
MOST = 1 << 27
#: Vectors that one numpy pass handles.
CHUNK = 8192
#: Unit roundoff of float32.
UNIT = 2.0**-24


def screen(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance, entries told apart in int64) of each row of int64 ``x``.

    Standard model of rounding: a float32 sum of n products of rounded factors is off by at most
    gamma(n + 2) |x|.|c|, gamma(k) = k u / (1 - k u), in whatever order it is summed.  The norm and the
    last addition add gamma(n + 2) |c|^2 and one more u of the parts.  The interval's width is
    taken twice as large, which covers that it is computed in floating point (float64) itself.
    """
    n, k = x.shape[1], len(entries)
    wide_x, wide_c = x.astype(np.float64), entries.astype(np.float64)
    x32, c32 = x.astype(np.float32), entries.astype(np.float32)
    norms = (c32 * c32).sum(axis=1, dtype=np.float32)
    value = (norms[None, :] - np.float32(2) * (x32 @ c32.T)).astype(np.float64)
    gamma = (n + 4) * UNIT / (1 - (n + 4) * UNIT)
    reach = 2 * gamma * ((wide_c * wide_c).sum(axis=1)[None, :] + 2 * (np.abs(wide_x) @ np.abs(wide_c).T)) + 1.0
    near = value - reach <= (value + reach).min(axis=1)[:, None]
    rows, cols = np.nonzero(near)
    gap = x[rows] - entries[cols]
    exact = np.full((len(x), k), np.iinfo(np.int64).max)
    exact[rows, cols] = np.einsum("ij,ij->i", gap, gap)
    best = exact.argmin(axis=1)  # the first of equal ones
    return best, exact[np.arange(len(x)), best], len(rows)


def _integers(batch: pa.RecordBatch, at: int, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, int64 matrix) of the batch's vectors; all have ``width`` components."""
    column = batch.column(at)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for start in range(0, len(column), CHUNK):
        end = min(start + CHUNK, len(column))
        part = np.floor(np.clip(flat[start * width : end * width] * SCALE, -float(MOST), float(MOST)))
        yield start, end, part.astype(np.int64).reshape(end - start, width)


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, vector, label) of vectors that are not null and hold only finite components."""
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return kept.filter(F.col("vector").isNotNull() & finite)


def _round(fit: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    size = width // len(books)
    names = [f"s{j}" for j in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), size), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, _, x in _integers(batch, 0, width):
                for p, book in enumerate(books):
                    part = x[:, p * size : (p + 1) * size]
                    best, _, _ = screen(part, book)
                    np.add.at(sums[p], best, part)
                    counts[p] += np.bincount(best, minlength=len(book))
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            cols = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]), *(pa.array(sums[p][used, j]) for j in range(size))]
            yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", *names])

    made = fit.select("vector").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
    found = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()  # PARTS x ENTRIES rows at most
    books = [b.copy() for b in books]
    for r in found:
        books[r["part"]][r["entry"]] = [r[c] // r["n"] for c in names]
    return books


def train(fit: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks by part.  They start from the vectors of the least vec_ids (a repeated vec_id once, by its least vector; a null one last)."""
    ids = [r["vec_id"] for r in fit.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]  # only ids are shuffled
    wanted = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() & F.lit(None in ids))
    first = fit.filter(wanted).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last())
    seeds = np.array([r["vector"] for r in first.collect()], np.float64).reshape(-1, width)
    seeds = np.floor(np.clip(seeds * SCALE, -float(MOST), float(MOST))).astype(np.int64)
    books = [b.copy() for b in np.split(seeds, parts, axis=1)]
    for _ in range(rounds):
        books = _round(fit, books, width)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector: two hex digits a part, its squared distance in integers, that summed over the rows of its label.

    Vectors that are null or hold a null or non-finite component are dropped.  A component beyond
    32768 counts as 32768.  The table's width is the commonest length that the parts divide (of equally
    common ones the longer); vectors of another length stay with a null code and error, and take no part
    in the codebooks.  Repeated rows count as often as they stand.  Rows of null labels are one group; a
    group of vectors without code has a null label_error.  Without usable vectors nothing is returned.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is written in two hex digits: 1 to 256 entries")
    rows = usable(df, id_col, vector_col, label_col)
    size = F.size("vector")
    widths = rows.groupBy(size.alias("width")).count().filter((F.col("width") > 0) & (F.col("width") % parts == 0))
    commonest = widths.orderBy(F.desc("count"), F.desc("width")).first()
    width = commonest["width"] if commonest else 0
    fit = rows.filter(size == width) if width else rows.limit(0)
    books = train(fit, width, parts, entries, rounds) if width else []
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, x in _integers(batch, 1, width):
                code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, book in enumerate(books):
                    best, far, _ = screen(x[:, p * step : (p + 1) * step], book)
                    code[:, p] = best
                    error += far
                text = [c.tobytes().hex() for c in code]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(2).slice(start, end - start), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)["label"]
    coded = fit.select("vec_id", "vector", "label").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")
    odd = rows.filter(size != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    keyed = coded.unionByName(odd).select("vec_id", "code", "error", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))
    keyed = checkpoint(keyed)  # read twice: for the sums, and with them
    sums = checkpoint(keyed.groupBy("no_label", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    joined = join_counted(keyed, sums, ["no_label", "label"], total)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """SQL of ``encode`` where vec_id is a key and all vectors have one length."""
    ctes = [
        "kept as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * x::double) as bigint)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"x as materialized (select vec_id, p::int as part, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) as c from kept, range({parts}) t(p))",
        f"seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {entries})",
        "book0 as materialized (select part, entry, c as e from x join seeds using (vec_id))",
    ]
    near = "select vec_id, part, any_value(c) as c, arg_min(entry, (d, entry)) as entry, min(d) as d from (select vec_id, x.part as part, c, entry, list_sum(list_transform(list_zip(c, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x join book{r} b on b.part = x.part) group by vec_id, part"
    for r in range(rounds):
        ctes += [
            f"near{r} as materialized ({near.format(r=r)})",
            f"mean{r} as (select part, entry, list(m order by j) as e from (select part, entry, j, (s - ((s % n) + n) % n) // n as m from (select part, entry, j, sum(y)::bigint as s, count(*) as n from (select part, entry, unnest(c) as y, generate_subscripts(c, 1) as j from near{r}) group by all)) group by part, entry)",
            f"book{r + 1} as materialized (select b.part as part, b.entry as entry, coalesce(m.e, b.e) as e from book{r} b left join mean{r} m on m.part = b.part and m.entry = b.entry)",
        ]
    ctes += [
        f"last as materialized ({near.format(r=rounds)})",
        "coded as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from last group by vec_id)",
        f"sha as (select sha256(string_agg(y::varchar, ',' order by part, entry, j)) as codebooks_sha256 from (select part, entry, unnest(e) as y, generate_subscripts(e, 1) as j from book{rounds}))",
    ]
    return "with " + ", ".join(ctes) + " select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id), sha"
