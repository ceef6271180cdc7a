"""Token counts through a cache: a text is encoded once for each version of a tokenizer, whoever asks again.

The cache is a Parquet table of (version, content, n_tokens).  ``content`` is the SHA-256 of the
normalised text (its UTF-8 bytes, null as empty: any further change could change the count) and
``version`` that of the tokenizer's file with the name and version of the library that reads it.  Documents
are joined to the cache by digests; of those that miss, one document a text is encoded where it
lies, and the counts are appended.  Texts are not shuffled unless both the documents to encode and
those to leave out are too many for a broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfin.llm.common import MOST_BROADCAST, PIECE_BYTES, checkpoint, ensure_checkpoint_dir, join_counted

#: Tokens from which on (exclusive) a document is over the limit.
LIMIT = 1024
SCHEMA = "version string, content string, n_tokens long"
#: Digests, and pre-tokens in each of two generations, that a task remembers so as to encode them once.
REMEMBERED = 300_000

#: Pre-tokens longer than this are not remembered.
LONG = 256
#: Code points that the library's splitter and the pattern's classes surely agree on; they know different versions of Unicode.
SETTLED = re.compile("[\u0000-\u0557\u2000-\u206f\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*")

#: Where a text may be cut for a byte-level pattern that takes one leading space with a word: before a single space between other characters.
CUT = re.compile(r"(?<=\S) (?=\S)")


def version_of(path: str) -> str:
    """Digest of a tokenizer: its file's bytes, and the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    elif path.endswith(".json"):
        import tokenizers as library
    else:
        raise ValueError(f"a tokenizer's file ends in .json or .model: {path}")
    with open(path, "rb") as f:
        made = hashlib.sha256(f.read())
    made.update(f"{library.__name__} {library.__version__}".encode())
    return made.hexdigest()


def _cuttable(spec: dict) -> bool:
    """True if counts add up over pieces cut at CUT: the plain byte-level splitter, no normaliser, no added token with a space in it or about it."""
    before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return bool(plain and not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added))


def pieces(text: str, limit: int) -> list[str]:
    """The text cut at CUT into pieces of at least ``limit`` characters (the last may be shorter); one without such a place stays whole."""
    out, start = [], 0
    while len(text) - start > limit and (cut := CUT.search(text, start + limit)):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


class _Words:
    """Token counts of texts from those of their pre-tokens, each of which the library encodes once as long as it is remembered (two bounded generations)."""

    def __init__(self, encode: Callable[[list[str]], list[int]], added: list[str]):
        self.encode, self.split = encode, regex.compile(public_tokenizers.PATTERN).findall
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.added and (found := self.added.findall(text)):
            total, parts = len(found), self.added.split(text)
        for words in map(self.split, parts):
            lacking = [w for w in dict.fromkeys(words) if w not in self.new]
            unknown = [w for w in lacking if w not in self.old]
            self.new.update((w, self.old[w]) for w in lacking if w in self.old)
            self.new.update(zip(unknown, self.encode(unknown)))
            total += sum(map(self.new.__getitem__, words))
            for w in lacking:
                if len(w) > LONG:
                    del self.new[w]
            if len(self.new) > REMEMBERED:
                self.new, self.old = {}, self.new
        return total


def counter(path: str, limit: int = PIECE_BYTES) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, add_bos=False, add_eos=False, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    encode = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if not _cuttable(spec):
        return lambda texts: [n for t in texts for n in encode([t])]
    words = _Words(encode, [t["content"] for t in spec.get("added_tokens") or []])
    # tokens of a piece are held at a time, not of a whole text
    return lambda texts: [sum(words.count(p) if SETTLED.fullmatch(p) else encode([p])[0] for p in pieces(t, limit)) for t in texts]


def _encode(rows: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of rows (content, text); a text once a task, so far as digests are remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = None, {}
        for batch in batches:
            count = count or counter(path)
            digests, new = batch.column(0).to_pylist(), []
            for i, d in enumerate(digests):
                if d not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[d] = True
                    new.append(i)
            if new:
                picked = pa.array(new)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), pa.array(count([batch.column(1)[i].as_py() for i in new]), pa.int64())], ["content", "n_tokens"])

    return rows.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache of a folder; an empty one where nothing has been written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(SCHEMA).parquet(folder) if there else spark.createDataFrame([], SCHEMA)


def count_tokens(df: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; counts that ``cache`` (a folder) lacks are made and appended to it.

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows stay as often as
    they stand and are encoded once; further columns are left out.  Special strings in a text
    are handled as the library does by default.  A cache that holds a digest several times (two
    writers at once) holds equal counts, and one is used.  A job that fails before its append ends
    leaves the cache as it was.
    """
    spark, version = df.sparkSession, version_of(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("content"))
    digests = checkpoint(docs.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")))
    # One document stands for each text: of the least id, null last.
    texts = digests.groupBy("content").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    known = read_cache(spark, cache).filter(F.col("version") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    found = checkpoint(texts.join(known, "content", "left"))
    told = lambda rows, first: rows.select(F.col("content").alias("_content"), F.col(first).alias("_first"))
    same = (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    missing = found.filter("n_tokens is null")
    misses, n_misses, total = told(missing, "first"), missing.count(), found.agg(F.sum("n")).first()[0] or 0
    if n_misses:
        if n_misses <= MOST_BROADCAST:
            rows = docs.join(F.broadcast(misses), same, "left_semi")
        elif total - n_misses <= MOST_BROADCAST:  # nearly all are to be encoded: the others are told
            stand = found.select("content", "first", "n_tokens")
            others = digests.join(stand, "content").filter(F.col("n_tokens").isNotNull() | ~F.col("doc_id").eqNullSafe(F.col("first")))
            rows = docs.join(F.broadcast(told(others, "doc_id")), same, "left_anti")
        else:
            rows = docs.join(misses, same, "left_semi")
        made = checkpoint(_encode(rows, path).groupBy("content").agg(F.min("n_tokens").alias("n_tokens")))
        made.select(F.lit(version).alias("version"), "content", "n_tokens").write.mode("append").parquet(cache)
        counts = found.select("content", "n", F.col("n_tokens").alias("known")).join(made, "content", "left").select("content", "n", F.coalesce("known", "n_tokens").alias("n_tokens"))
    else:
        counts = found.select("content", "n", "n_tokens")
    joined = join_counted(digests, checkpoint(counts), ["content"], total)
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    """A folder that no other run uses, below the folder that the cluster shares."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/token-counts-{uuid.uuid4().hex}"


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
