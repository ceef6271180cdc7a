"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

score = sigmoid(b + w.x + 1/2 * sum_f ((V_f.x)**2 - V_f**2.x**2)): all pairwise interactions at rank
``RANK`` in time linear in the features that a text has.

Features are made where the texts lie; only a bounded sample of labelled rows' features goes to the
driver, where the model is fitted.  The fitted model (a fixed number of floats) is broadcast and
scores whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import text_pieces, word_hashes

#: Hashed word slots (their number fixes the model's size), rank, and the bound on labelled rows that are fitted on.
SLOTS, RANK, SAMPLE = 1 << 13, 4, 4000
#: Length of a text's word features together: statistics, each up to about 1, should weigh more than single words.
WORD_LENGTH = 0.3
#: Structure statistics and metadata, in their order.
STATISTICS = (
    "log_chars", "log_words", "mean_word", "symbols", "digits", "upper", "pipes", "bangs", "symbols_per_word", "lines", "short_lines",
    "stops", "commas", "high_bytes", "repeated_words", "inner_symbols", "log_metadata_chars", "empty",
)
N_STATS = len(STATISTICS)

_CLASS = np.full(256, 15, np.uint8)
for _row, _chars in enumerate((b"#$%&*@^~_+=<>\\{}[]", b"0123456789", bytes(range(65, 91)), b"|", b"!?", b"\n", b".", b",;:", bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _row
_CLASS[[0x20, 9, 11, 12, 13]] = 9


def features(data: np.ndarray, offsets: np.ndarray, n_chars: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text: statistics first, then its distinct words' slots with values of length WORD_LENGTH in all."""
    words, at = word_hashes(data, offsets)
    slots = (words >> np.uint64(51)).astype(np.int64)  # 13 bits
    kinds = _CLASS[data]
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        n, w = b - a, slots[at[i] : at[i + 1]]
        counts = np.bincount(kinds[a:b], minlength=16)
        size, n_words, n_lines = max(1, n), max(1, len(w)), int(counts[5]) + 1
        unique, times = np.unique(w, return_counts=True)
        stats = np.array([
            np.log1p(n) / 10, np.log1p(len(w)) / 10, min(4.0, (n - counts[9]) / n_words / 10), min(4.0, 10 * counts[0] / size), 10 * counts[1] / size, 3 * counts[2] / size,
            min(4.0, 20 * counts[3] / size), min(4.0, 20 * counts[4] / size), min(4.0, counts[0] / n_words), min(4.0, 10 * n_lines / n_words), 1.0 if n / n_lines < 30 else 0.0,
            min(4.0, 5 * counts[6] / n_words), min(4.0, 5 * counts[7] / n_words), 2 * counts[8] / size, 1 - len(unique) / n_words, min(4.0, (counts[0] + counts[3] + counts[4]) / n_words),
            np.log1p(max(0, n_chars[i] if n_chars[i] is not None else n)) / 10, float(len(w) == 0),
        ])
        values = np.log1p(times)
        values = WORD_LENGTH * values / max(1e-9, np.sqrt((values**2).sum()))
        yield np.concatenate([np.arange(N_STATS), N_STATS + unique]), np.concatenate([stats, values])


class Machine:
    """Parameters of a factorisation machine and its scores."""

    def __init__(self, size: int = N_STATS + SLOTS, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.01, (size, rank))

    def margin(self, slots: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        vx = x @ self.v[slots]
        return self.b + x @ self.w[slots] + 0.5 * (vx @ vx - (x**2) @ (self.v[slots] ** 2).sum(1)), vx

    def score(self, slots: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + np.exp(-np.clip(self.margin(slots, x)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 12, rate: float = 0.1, penalty: float = 1e-5, seed: int = 7) -> Machine:
        """AdaGrad on the log loss; both classes weigh the same in all."""
        rng = np.random.default_rng(seed)
        y = np.array(labels, float)
        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) if len(y) else y
        gb, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                slots, x = rows[i]
                m, vx = self.margin(slots, x)
                g = weight[i] * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[i])
                v = self.v[slots]
                dw = g * x + penalty * self.w[slots]
                dv = g * (np.outer(x, vx) - v * (x**2)[:, None]) + penalty * v
                gb += g * g
                gw[slots] += dw**2
                gv[slots] += dv**2
                self.b -= rate * g / np.sqrt(gb)
                self.w[slots] -= rate * dw / np.sqrt(gw[slots])
                self.v[slots] -= rate * dv / np.sqrt(gv[slots])
        return self


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _inputs(df: DataFrame, id_col: str, text_col: str, chars_col: str | None) -> DataFrame:
    chars = F.col(chars_col).cast("long") if chars_col and chars_col in df.columns else F.lit(None).cast("long")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), chars.alias("n_chars"))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows (those whose ids hash lowest, one for each id) that are not held out.  Null ids and labels are left out; without rows, scores are 0.5."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = _inputs(df, id_col, text_col, chars_col).join(F.broadcast(taken), "doc_id")
    # of rows that repeat an id one stays (that of the least text hash), so that the sample bounds rows and not only ids
    rows = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "n_chars", "label")).alias("r")).select("doc_id", "r.text", "r.n_chars", "r.label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, found = batch.column(2).to_pylist(), []
            for first, end, data, offsets in text_pieces(batch.column(1)):
                found += features(data, offsets, chars[first:end])
            slots = pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32()))
            values = pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), slots, values], ["doc_id", "label", "slots", "x"])

    got = rows.mapInArrow(run, "doc_id long, label int, slots array<int>, x array<float>").toArrow()  # bounded by ``sample``
    got = got.sort_by("doc_id")
    sparse = [(np.array(s), np.array(x)) for s, x in zip(got["slots"].to_pylist(), got["x"].to_pylist())]
    return Machine().fit(sparse, got["label"].to_pylist())


def score_documents(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """(doc_id, score double) for every row in turn; null and empty texts have the features of an empty text."""
    model = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for batch in batches:
            chars, scores = batch.column(2).to_pylist(), []
            for first, end, data, offsets in text_pieces(batch.column(1)):
                scores += [machine.score(s, x) for s, x in features(data, offsets, chars[first:end])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return _inputs(df, id_col, text_col, chars_col).mapInArrow(run, "doc_id long, score double")


def keep_good(df: DataFrame, machine: Machine, threshold: float = 0.7, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows, with all their columns, whose texts score at least the threshold; judged where they lie, without a shuffle."""
    model = df.sparkSession.sparkContext.broadcast(machine)
    text_at, chars_at = df.columns.index(text_col), df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for batch in batches:
            chars = batch.column(chars_at).to_pylist() if chars_at is not None else [None] * batch.num_rows
            good: list[bool] = []
            for first, end, data, offsets in text_pieces(batch.column(text_at)):
                good += [bool(machine.score(s, x) >= threshold) for s, x in features(data, offsets, chars[first:end])]
            yield batch.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def classify(df: DataFrame, labels: DataFrame, threshold: float = 0.7, **columns) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; predicted is 1 if score >= threshold."""
    scored = score_documents(df, train(df, labels, **columns), **{k: v for k, v in columns.items() if k != "label_col"})
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
