"""Removal of passages that earlier documents hold, by prefix-free parsing and suffix arrays of the dictionary.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document of a smaller id.

Parsing.  A rolling hash runs over all TRIGGER-byte windows.  Each LENGTH-byte string is assigned the
least trigger hash inside it, which depends on its bytes alone, so equal strings get equal triggers
wherever they stand.  Consecutive strings with one trigger make a phrase; neighbouring phrases
overlap by LENGTH - 1 bytes, so each string lies in exactly one phrase and no phrase's order depends
on what follows it.

Corpus order.  Phrases of one trigger range form a dictionary.  Its suffix array, ordered to LENGTH
bytes by prefix doubling (8, 16, 32, LENGTH; exact ranks, no hashes), gives each string's rank; the
parse tells which documents hold a phrase, so the least document of each rank follows.  Because of
the overlap the dictionary's order to LENGTH bytes is the corpus's, and no document is ever sorted.

Exchange.  Documents are dealt once into blocks of bounded bytes.  (1) Each block sends its distinct
trigger codes, four bytes each, by range; ranges answer one bit a code: does another document hold
it?  (2) Blocks send the distinct phrases of those codes with the least document that holds each,
compressed; ranges answer one bit a string.  (3) Blocks mark their documents.  A passage that a third
of all documents hold is sent once a block, not once a document; a trigger with very many phrases is
told as hot in (1), and its strings then have codes of their own, so no range is one trigger's.  It is
one plan: the blocks' exchange is reused by the three passes, and lost executors are recomputed from it.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import clean_ids, mix

LENGTH, TRIGGER = 50, 20
#: Text bytes in a block (and so a task's memory), bytes hashed at once, and strings in a phrase at most.
BLOCK_BYTES, PIECE, LONGEST = 8 << 20, 1 << 20, 64
#: Distinct phrases of a code in a block from which it tells their number, and phrases of a code in all from which it is hot.
TOLD_FROM, HOT_PHRASES = 8, 200_000

_A = 0x9E3779B97F4A7C15
_LETTER = mix(np.arange(1, 257, dtype=np.uint64))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_A, n, 1 << 64))


def triggers(data: np.ndarray) -> np.ndarray:
    """For each start of LENGTH bytes, the least hash of the TRIGGER-byte windows inside."""
    h1 = _LETTER[data]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    n = len(data) - TRIGGER + 1
    m = mix(h16[:n] * _power(4) + h4[16 : 16 + n])
    width, window = 1, LENGTH - TRIGGER + 1
    while 2 * width <= window:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    if width < window:
        m = np.minimum(m[: len(m) - (window - width)], m[window - width :])
    return m


class Block:
    """The phrases of a block's documents."""

    def __init__(self, table: pa.Table, ranges: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id").combine_chunks()
        self.known = ~self.ids.is_null().to_numpy(zero_copy_only=False)
        self.doc_ids = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        texts = table.column("text").cast(pa.large_binary()).combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        texts = texts.fill_null(b"")
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self._parse(ranges)

    def _parse(self, ranges: int) -> None:
        """Arrays of all phrases: doc, start (in data), count of strings, code = range << 32 | 32 bits of trigger."""
        lo, hi = (int(self.offsets[0]), int(self.offsets[-1])) if len(self.offsets) else (0, 0)
        starts, counts, keys = [], [], []
        at = lo
        while at + LENGTH <= hi:
            end = min(hi, at + PIECE + LENGTH - 1)
            key = triggers(self.data[at:end])
            n = len(key)
            cut = np.zeros(n + 1, bool)
            cut[0] = cut[n] = True
            cut[1:n] = key[1:] != key[:-1]
            borders = self.offsets[(self.offsets > at) & (self.offsets < at + n + LENGTH)] - at
            bad = np.zeros(n + 1, np.int32)  # starts within LENGTH - 1 bytes before a border cross it
            first = np.maximum(0, borders - LENGTH + 1)
            np.add.at(bad, np.minimum(first, n), 1)
            np.add.at(bad, np.minimum(borders, n), -1)
            good = np.cumsum(bad)[:n] == 0
            cut[1:n] |= good[1:] != good[:-1]
            cut[borders[borders < n]] = True
            s = np.flatnonzero(cut)
            s, c = s[:-1], np.diff(s)
            ok = good[s]
            s, c = s[ok], c[ok]
            long = c > LONGEST
            if long.any():
                parts = -(-c // LONGEST)
                within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                s, c = np.repeat(s, parts) + within * LONGEST, np.minimum(LONGEST, np.repeat(c, parts) - within * LONGEST)
            starts.append(s + at)
            counts.append(c)
            keys.append(key[s])
            at += n
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        known = self.known[self.doc] if len(self.doc) else np.zeros(0, bool)
        self.start, self.count, self.doc, key = self.start[known], self.count[known], self.doc[known], key[known]
        # the trigger is a least hash and so small: spread it before it is cut
        self.ranges = ranges
        self.code = self._code(mix(key + np.uint64(1)))

    def _code(self, key: np.ndarray) -> np.ndarray:
        return (((key >> np.uint64(32)) * np.uint64(self.ranges)) & ~np.uint64(0xFFFFFFFF)) | (key & np.uint64(0xFFFFFFFF))

    def codes(self, told_from: int = TOLD_FROM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct codes, whether two documents of this block hold each, and the number of its distinct phrases if that is ``told_from`` or more, else 0."""
        order = np.argsort(self.code, kind="stable")
        code, doc = self.code[order], self.doc_ids[self.doc[order]]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        if not len(at):
            return code, np.zeros(0, bool), np.zeros(0, np.int64)
        times = np.diff(np.append(at, len(code)))
        told = np.zeros(len(at), np.int64)
        often = np.repeat(times >= told_from, times)
        if often.any():
            pairs = np.unique(np.stack([np.repeat(np.arange(len(at)), times)[often].astype(np.uint64), self._digests(self.start[order[often]], self.count[order[often]] + LENGTH - 1)], 1), axis=0)
            which, n = np.unique(pairs[:, 0].astype(np.int64), return_counts=True)
            told[which[n >= told_from]] = n[n >= told_from]
        return code[at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at), told

    def split(self, hot: np.ndarray) -> np.ndarray:
        """Make each string of the phrases of hot codes a phrase of its own, whose code is of all its bytes; returns these codes.

        So the strings of a trigger that stands in ever different surroundings are dealt to all ranges.
        """
        if not len(hot):
            return hot
        of = np.isin(self.code, hot)
        start = np.repeat(self.start[of], self.count[of]) + _within(self.count[of])
        doc, one = np.repeat(self.doc[of], self.count[of]), np.ones(len(start), np.int64)
        code = self._code(mix(self._digests(start, one + LENGTH - 1) + np.uint64(7)))
        self.start, self.count = np.concatenate([self.start[~of], start]), np.concatenate([self.count[~of], one])
        self.doc, self.code = np.concatenate([self.doc[~of], doc]), np.concatenate([self.code[~of], code])
        return np.unique(code)

    def _digests(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        digest = np.zeros(len(size), np.uint64)
        for at in range(0, len(size), 4096):
            rows = self._rows(start[at : at + 4096], size[at : at + 4096])
            eight = rows.view(np.uint64)  # LONGEST + LENGTH - 1 bytes, padded to eights
            h = size[at : at + 4096].astype(np.uint64)
            for j in range(eight.shape[1]):
                h = mix(h ^ eight[:, j]) + np.uint64(j)
            digest[at : at + 4096] = h
        return digest

    def phrases(self, shared: np.ndarray) -> None:
        """Keep phrases of shared codes and number the distinct ones by code and hash: phrase, and per distinct one code, size, place and least doc."""
        held = np.isin(self.code, shared)
        self.start, self.count, self.doc, self.code = self.start[held], self.count[held], self.doc[held], self.code[held]
        size = self.count + LENGTH - 1
        digest = self._digests(self.start, size)
        order = np.lexsort((self.doc, digest, self.code))
        new = np.ones(len(order), bool)
        a, b = order[:-1], order[1:]
        new[1:] = (self.code[a] != self.code[b]) | (digest[a] != digest[b]) | (size[a] != size[b])
        for at in range(0, max(0, len(order) - 1), 4096):  # equal digests are compared in full
            x, y = a[at : at + 4096], b[at : at + 4096]
            same = ~new[1 + at : 1 + at + len(x)]
            if same.any():
                differ = (self._rows(self.start[x[same]], size[x[same]]) != self._rows(self.start[y[same]], size[y[same]])).any(1)
                new[1 + at + np.flatnonzero(same)[differ]] = True
        self.phrase = np.zeros(len(order), np.int64)
        self.phrase[order] = np.cumsum(new) - 1
        heads = order[new]  # documents are in order of id, so a group's first has the least
        self.phrase_code, self.phrase_start, self.phrase_size = self.code[heads], self.start[heads], size[heads]
        self.phrase_doc = self.doc_ids[self.doc[heads]]

    def _rows(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        width = -(-(LONGEST + LENGTH - 1) // 8) * 8
        at = np.arange(width)
        inside = at[None, :] < size[:, None]
        return np.where(inside, self.data[np.minimum(start[:, None] + at[None, :], len(self.data) - 1)], np.uint8(0))

    def spans(self, repeated: np.ndarray) -> list[list[tuple[int, int]]]:
        """Removed byte spans of each document; repeated: one flag per string of each distinct phrase in turn."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(self.doc_ids))]
        if not len(self.phrase):
            return out
        first = np.concatenate([[0], np.cumsum(self.phrase_size - LENGTH + 1)])
        index = np.repeat(first[self.phrase], self.count) + _within(self.count)
        hit = repeated[index] | np.repeat(self.doc_ids[self.doc] > self.phrase_doc[self.phrase], self.count)
        place, doc = (np.repeat(self.start, self.count) + _within(self.count))[hit], np.repeat(self.doc, self.count)[hit]
        if not len(place):
            return out
        order = np.argsort(place, kind="stable")
        place, doc = place[order], doc[order]
        new = np.concatenate([[True], (place[1:] > place[:-1] + LENGTH) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(new)
        ends = np.concatenate([at[1:], [len(place)]]) - 1
        for d, s, e in zip(doc[at].tolist(), place[at].tolist(), (place[ends] + LENGTH).tolist()):
            out[d].append((s - int(self.offsets[d]), e - int(self.offsets[d])))
        return out


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the sorted distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if len(keys) else 0
    return rank


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of each place's first LENGTH bytes (places nearer the end have none), by prefix doubling."""
    n = len(text) - 7
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | text[j : j + n]
    rank, width = _dense(words), 8
    while width < LENGTH:
        step = min(width, LENGTH - width)
        pairs = (rank[: len(rank) - step] << np.uint64(32)) | rank[step:]
        rank, width = _dense(pairs), width + step
    return rank


def _unpack(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r.get("range", r.get("block")))


def _by_range(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, first, end) of the ranges that sorted codes fall in: however many ranges there are, a block has no more messages than codes."""
    held, first = np.unique(codes >> np.uint64(32), return_index=True)
    return list(zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(codes)]))


def _send_codes(table: pa.Table, ranges: int, told_from: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    codes, several, told = Block(table, ranges).codes(told_from)
    held = _by_range(codes)
    return pa.table(
        {
            "range": pa.array([r for r, _, _ in held], pa.int32()), "block": pa.array([block] * len(held), pa.int32()),
            "codes": pa.array([codes[a:b].astype(np.uint32).tobytes() for _, a, b in held], pa.binary()),
            "several": pa.array([np.packbits(several[a:b]).tobytes() for _, a, b in held], pa.binary()),
            "told": pa.array([np.stack([np.flatnonzero(told[a:b]), told[a:b][told[a:b] > 0]]).astype(np.uint32).tobytes() for _, a, b in held], pa.binary()),
        }
    )


def _answer_codes(table: pa.Table, told_from: int, hot_phrases: int) -> pa.Table:
    """Per block of one range: the codes that another document (of any block) holds too, and which of them are hot."""
    rows = _unpack(table.drop_columns("range"))
    codes = [np.frombuffer(r["codes"], np.uint32) for r in rows]
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(c)).astype(bool) for r, c in zip(rows, codes)])
    flat = np.concatenate(codes)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    twice = several[order]
    twice[1:] |= ordered[1:] == ordered[:-1]
    twice[:-1] |= ordered[1:] == ordered[:-1]
    shared = np.zeros(len(flat), bool)
    shared[order] = twice
    # a code that is in one block is shared there if two of its documents hold it; in two blocks, by both
    ends = np.cumsum([0, *map(len, codes)])
    # a code has under ``told_from`` phrases in a block that tells none of it
    phrases = np.full(len(flat), told_from, np.int64)
    for row, begin in zip(rows, ends[:-1]):
        where, n = np.frombuffer(row["told"], np.uint32).reshape(2, -1).astype(np.int64)
        phrases[begin + where] = n
    distinct, number = np.unique(flat, return_inverse=True)
    hot = shared & (np.bincount(number, weights=phrases, minlength=len(distinct))[number] > hot_phrases)
    r = table.column("range")[0].as_py()
    return pa.table(
        {
            "block": pa.array([x["block"] for x in rows], pa.int32()), "range": pa.array([r] * len(rows), pa.int32()),
            "shared": pa.array([c[shared[a:b]].tobytes() for c, a, b in zip(codes, ends[:-1], ends[1:])], pa.binary()),
            "hot": pa.array([c[hot[a:b]].tobytes() for c, a, b in zip(codes, ends[:-1], ends[1:])], pa.binary()),
        }
    )


def _told_codes(rows: list[dict], name: str) -> np.ndarray:
    parts = [np.frombuffer(r[name], np.uint32).astype(np.uint64) | (np.uint64(r["range"]) << np.uint64(32)) for r in rows if r[name]]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


_PHRASES = "range int, block int, n int, bytes long, codes binary, sizes binary, docs binary, text binary"


def _send_phrases(blocks: pa.Table, answers: pa.Table, ranges: int) -> pa.Table:
    names = [x.split()[0] for x in _PHRASES.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    out: list[list] = [[] for _ in names]
    if blocks.num_rows and answers.num_rows:
        block, told = Block(blocks, ranges), _unpack(answers)
        strings = block.split(_told_codes(told, "hot"))
        block.phrases(np.concatenate([_told_codes(told, "shared"), strings]))
        for r, a, b in _by_range(block.phrase_code):
            sizes = block.phrase_size[a:b]
            text = block.data[np.repeat(block.phrase_start[a:b], sizes) + _within(sizes)].tobytes()
            row = (r, blocks.column("block")[0].as_py(), b - a, len(text), block.phrase_code[a:b].astype(np.uint32).tobytes(), sizes.astype(np.uint8).tobytes(), block.phrase_doc[a:b].astype(np.int64).tobytes(), pa.compress(text, "zstd", asbytes=True))
            for column, value in zip(out, row):
                column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names)


def _answer_phrases(table: pa.Table) -> pa.Table:
    """Per block of one range: for each string of each phrase sent, whether a document under the phrase's least one holds it."""
    rows = _unpack(table.drop_columns("range"))
    text = np.frombuffer(b"".join(pa.decompress(r["text"], r["bytes"], "zstd", asbytes=True) for r in rows), np.uint8)
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint8) for r in rows]).astype(np.int64)
    docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows])
    starts = np.cumsum(sizes) - sizes
    # the dictionary: each distinct phrase once
    distinct: dict[bytes, int] = {}
    raw = text.tobytes()
    number = np.fromiter((distinct.setdefault(raw[a : a + n], len(distinct)) for a, n in zip(starts.tolist(), sizes.tolist())), np.int64, len(sizes))
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, number, docs)
    phrases = list(distinct)
    length = np.fromiter(map(len, phrases), np.int64, len(phrases))
    strings = length - LENGTH + 1
    of_string = np.repeat(least, strings)
    # only where a trigger's code has several phrases can two phrases share a string: these are ordered
    code = np.zeros(len(phrases), np.uint32)
    code[number] = np.concatenate([np.frombuffer(r["codes"], np.uint32) for r in rows])
    _, of_code, times = np.unique(code, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[of_code] > 1)
    if len(several):
        dictionary = np.frombuffer(b"".join([phrases[i] for i in several.tolist()]), np.uint8)
        size, count = length[several], strings[several]
        places = np.repeat(np.cumsum(size) - size, count) + _within(count)
        rank = suffix_ranks(dictionary)[places].astype(np.int64)
        first = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, rank, np.repeat(least[several], count))
        of_string[np.repeat(times[of_code] > 1, strings)] = first[rank]
    begin = np.cumsum(strings) - strings
    counts = sizes - LENGTH + 1
    repeated = of_string[np.repeat(begin[number], counts) + _within(counts)] < np.repeat(docs, counts)
    ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *(r["n"] for r in rows)])]
    r = table.column("range")[0].as_py()
    return pa.table(
        {
            "block": pa.array([x["block"] for x in rows], pa.int32()), "range": pa.array([r] * len(rows), pa.int32()),
            "shared": pa.array([np.unique(np.frombuffer(x["codes"], np.uint32)).tobytes() for x in rows], pa.binary()),
            "repeated": pa.array([np.packbits(repeated[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
        }
    )


_MARKED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _mark(blocks: pa.Table, answers: pa.Table, ranges: int) -> pa.Table:
    if not blocks.num_rows:
        return _MARKED.empty_table()
    block, told = Block(blocks, ranges), _unpack(answers)
    block.split(_told_codes(told, "hot"))
    rows = [r for r in told if r["repeated"] is not None]
    block.phrases(_told_codes(rows, "shared"))
    counts = block.phrase_size - LENGTH + 1
    ends = {r: (a, b) for r, a, b in _by_range(block.phrase_code)}
    flags = [np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=int(counts[slice(*ends[r["range"]])].sum())).astype(bool) for r in rows]
    spans = block.spans(np.concatenate(flags) if flags else np.zeros(0, bool))
    kept = []
    for d, cuts in enumerate(spans):
        text, at_byte, parts = block.data[block.offsets[d] : block.offsets[d + 1]].tobytes(), 0, []
        for s, e in cuts:
            parts.append(text[at_byte:s])
            at_byte = e
        kept.append(b"".join([*parts, text[at_byte:]]))
    spans = [[{"start": s, "end": e} for s, e in cuts] for cuts in spans]
    return pa.Table.from_arrays([block.ids, pa.array(np.diff(block.offsets)), pa.array(spans, _MARKED.field("spans").type), pa.array(kept, pa.binary())], schema=_MARKED)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, told_from: int = TOLD_FROM, hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """Per row: doc_id, n_bytes long, spans array<start, end> (maximal removed byte runs), kept binary.

    Texts count as UTF-8 bytes, null as empty.  Strings are judged on the input, never across texts.
    Rows of one doc_id are one document: none removes from another.  Rows with a null doc_id are
    returned whole and take nothing from others.
    """
    every = clean_ids(df, id_col, text_col)
    docs = every.filter("doc_id is not null")
    text = F.coalesce("text", F.lit(""))
    apart = every.filter("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"), text.cast("binary").alias("kept"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(size) // block_bytes))
    # as many partitions as blocks: a task's work is a few blocks however many there are
    blocks = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"), "doc_id", "text")
    by_block = blocks.repartition(n, "block").groupBy("block")
    sent = by_block.applyInArrow(lambda t: _send_codes(t, n, told_from), "range int, block int, codes binary, several binary, told binary")
    answers = sent.repartition(n, "range").groupBy("range").applyInArrow(lambda t: _answer_codes(t, told_from, hot_phrases), "block int, range int, shared binary, hot binary").filter(F.length("shared") > 0)
    answers = answers.repartition(n, "block")
    phrases = by_block.cogroup(answers.groupBy("block")).applyInArrow(lambda b, a: _send_phrases(b, a, n), _PHRASES)
    verdicts = phrases.repartition(n, "range").groupBy("range").applyInArrow(_answer_phrases, "block int, range int, shared binary, repeated binary")
    none = F.lit(None).cast("binary")
    hot = answers.filter(F.length("hot") > 0).select("block", "range", none.alias("shared"), none.alias("repeated"), "hot")
    told = verdicts.withColumn("hot", none).unionByName(hot).repartition(n, "block")
    marked = by_block.cogroup(told.groupBy("block")).applyInArrow(lambda b, a: _mark(b, a, n), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return marked.unionByName(apart)


#: Every string of 50 bytes, as hexadecimal digits: for small tables.
ORACLE = """
with bytes as (select doc_id, hex(coalesce(text, '')) as h, length(hex(coalesce(text, ''))) // 2 as n from documents),
strings as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from bytes)),
first as (select s, min(doc_id) as low from strings group by s having min(doc_id) < max(doc_id)),
hits as (select doc_id, i from strings join first using (s) where doc_id > low),
marked as (select *, sum(new) over (partition by doc_id order by i) as run from (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from hits)),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from marked group by doc_id, run),
gaps as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b, 1 as gone, b - a as size from runs
  union all select doc_id, coalesce((select max(b) from runs where runs.doc_id = bytes.doc_id), 0), n, 0, 0 from bytes
)
select doc_id, n as n_bytes, sum(size)::bigint as n_removed, sum(gone)::bigint as n_spans, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (gaps.b - a)), '' order by a))) as kept_sha256
from gaps join bytes using (doc_id) group by doc_id, n
"""
