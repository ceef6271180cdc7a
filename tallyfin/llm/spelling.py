"""Spelling variants: words one insertion, deletion or replacement apart, found by automata of word halves.

Of two such words the one edit lies in one half of the longer or shorter word, so the other half
stands unchanged at the start or at the end of the other word.  An automaton shard (Aho-Corasick)
holds segments of words; words that come to the shard are scanned by it, a segment found must
stand at its offset and the lengths must fit, and then the words are compared.  Shards are hashed by
segment, so a word visits the few shards that can hold a segment of its own start or end (six at most)
and no shard twice.  A segment that very many words share is halved again: the part without edit grows
at one end or at the other, until few words share it or one code point is left, which only
words of the same code points elsewhere share (no more than the alphabet has).  No pair leaves a
shard: a word gets its number of near words there and the commonest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import checkpoint, small

#: Least code points and occurrences of a word; of hashes, every so many marks a changed occurrence.
LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97
#: How many times as common as a word its form must be.
TIMES = 2
#: Words that may share a segment before it is halved again; segments of a shard.
MOST_SHARED, SHARD = 64, 50_000
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of all texts in lower case (A-Z only), of enough code points and often enough.

    An occurrence whose hash with its document's id EVERY divides lacks one code point.  A null text has
    no runs; a null id is hashed as an empty one.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0)))
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    made = runs.select(F.when(h % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return made.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _key(word: Column, size: Column, a: Column, b: Column) -> Column:
    """Of words of ``size`` code points whose edit lies in [a, b): what stands before and after it, as told by a word that may be longer or shorter by one."""
    after = size - b
    return F.xxhash64(size, a, b, F.left(word, a), F.when(after > 0, F.right(word, after)).otherwise(""))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row's span [a, b) of a possible edit as its two halves."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    spans = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    kept = [c for c in rows.columns if c not in ("a", "b", "key")]
    cut = rows.select(*kept, F.inline(spans)).filter("a < b")
    return cut.withColumn("key", _key(F.col("word"), F.col("size"), F.col("a"), F.col("b")))


def places(counted: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """(word, n, size, a, b, key, role): the segments of words (role 0) and where words may visit (role 1, under the other word's size).

    Segments of more than ``most`` words are halved until none is left or their span is one code
    point; a level needs one aggregation of keys and one join, and there are as many as a
    long word's length has binary digits at most.
    """
    size = F.length("word")
    members = counted.select("word", "n", size.alias("size"), F.lit(0).alias("role"))
    sizes = F.explode(F.array(size - 1, size, size + 1))
    visits = counted.select("word", "n", sizes.alias("size"), F.lit(1).alias("role"))
    whole = members.unionByName(visits).filter("size > 0").select("word", "n", "size", "role", F.lit(0).alias("a"), F.col("size").alias("b"))
    open_, done = checkpoint(_halves(whole)), None
    while True:
        shared = open_.filter("role = 0 and b - a > 1").groupBy("key").count().filter(F.col("count") > most).select("key")
        shared = checkpoint(shared)
        if shared.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        hot = small(shared)
        wide = F.col("b") - F.col("a") > 1
        rest = open_.join(hot, "key", "left_anti").unionByName(open_.filter(~wide).join(hot, "key", "left_semi"))
        done = checkpoint(rest if done is None else done.unionByName(rest))
        open_ = checkpoint(_halves(open_.filter(wide).join(hot, "key", "left_semi")))


def _common(x: str, y: str) -> int:
    """Length of the longest common prefix; of long strings by halving."""
    low, high = 0, min(len(x), len(y))
    if high <= 32:
        while low < high and x[low] == y[low]:
            low += 1
        return low
    if x[:high] == y[:high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle)
    return low


def edit_place(w: str, v: str) -> int | None:
    """Where in w the one edit that makes it v stands (as far right as it can); None where the words are equal or further apart."""
    longer = len(w) - len(v)
    if not -1 <= longer <= 1 or w == v:
        return None
    p = _common(w, v) if w[:1] == v[:1] else 0
    same = w[p + 1 :] == v[p + 1 :] if not longer else w[p + 1 :] == v[p:] if longer > 0 else w[p:] == v[p + 1 :]
    return p if same else None


class _Shard:
    """Segments of a shard's words, their places, and what scanning has found for each word."""

    def __init__(self):
        self.nodes: dict[tuple[int, int, int, str, str], list[tuple[str, int]]] = {}
        self.words: list[str] = []
        self.near: list[int] = []
        self.best: list[tuple[int, str]] = []
        self.automaton = None

    def add(self, word: str, a: int, b: int) -> None:
        self.nodes.setdefault((len(word), a, b, word[:a], word[b:]), []).append((word[a:b], len(self.words)))
        self.words.append(word)
        self.near.append(0)
        self.best.append((0, ""))

    def build(self) -> None:
        # of a node's two segments the longer is looked for, the other compared; nodes by the length of their words
        by_segment: dict[str, dict[int, list]] = {}
        for (size, a, b, before, after), members in self.nodes.items():
            at_start = len(before) >= len(after)
            node = (at_start, before, after, a, size - b, b - a, b == size, members)
            by_segment.setdefault(before if at_start else after, {}).setdefault(size, []).append(node)
        self.automaton = ahocorasick.Automaton()
        for segment, nodes in by_segment.items():
            self.automaton.add_word(segment, (len(segment), nodes))
        self.automaton.make_automaton()

    def scan(self, v: str, n: int) -> None:
        size, near, best = len(v), self.near, self.best
        for end, (length, nodes) in self.automaton.iter(v):
            starts, ends = end + 1 == length, end + 1 == size
            if not (starts or ends):
                continue
            for of in (size - 1, size, size + 1):
                for at_start, before, after, a, tail, span, last, members in nodes.get(of, ()):
                    if not (starts if at_start else ends) or size - tail < a or not (v.endswith(after) if at_start else v.startswith(before)):
                        continue
                    between = v[a : size - tail]
                    for part, m in members:
                        # outside the span the words are equal; an edit belongs to the span of its rightmost place, so that a pair
                        # is met once, and one after the last code point to the last span
                        p = edit_place(part, between)
                        if p is not None and (last or p < span and (p < len(between) or part[p] != after[0])):
                            near[m] += 1
                            top, form = best[m]
                            if n > top or (n == top and v < form):
                                best[m] = (n, v)

    def found(self) -> pa.RecordBatch:
        at = [i for i, k in enumerate(self.near) if k]
        cols = [pa.array([self.words[i] for i in at], pa.string()), pa.array([self.near[i] for i in at], pa.int64()), pa.array([self.best[i][0] for i in at], pa.int64()), pa.array([self.best[i][1] for i in at], pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["word", "n_near", "near_n", "near"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, role, word, n, a, b) in order of shard and role: a shard's segments, then the words to scan, one at a time."""
    current, shard, last = None, None, None
    for batch in batches:
        for at, role, word, n, a, b in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if at != current:
                if shard:
                    yield shard.found()
                current, shard, last = at, _Shard(), None
            if role == 0:
                shard.add(word, a, b)
            elif shard.nodes and word != last:  # rows of a word come together; it is scanned once
                if shard.automaton is None:
                    shard.build()
                shard.scan(word, n)
                last = word
    if shard:
        yield shard.found()


def near_words(counted: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """(word, n_near, near_n, near): of each word with near words their number, and the commonest (the first in code-point order)."""
    spans = places(counted, most)
    # visits where no word has a segment are left out before they are dealt
    held = spans.filter("role = 0").select("key").distinct()
    spans = checkpoint(spans.filter("role = 0").unionByName(spans.filter("role = 1").join(held, "key", "left_semi")))
    shards = max(spans.filter("role = 0").count() // SHARD, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = spans.select(F.pmod("key", F.lit(shards)).alias("shard"), "role", "word", "n", "a", "b")
    rows = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "role", "word")
    found = rows.mapInArrow(_scan, "word string, n_near long, near_n long, near string")
    first = F.min(F.struct(-F.col("near_n"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("top")).select("word", "n_near", (-F.col("top.col1")).alias("near_n"), F.col("top.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms are followed to the last by doubling steps, as many as a chain's length has binary digits."""
    steps = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = steps.join(further, F.col("root") == F.col("_word"), "left")
        again = checkpoint(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if again.filter("moved").isEmpty():
            return again.drop("moved")
        steps = again.drop("moved")


def group_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, most: int = MOST_SHARED
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words``.

    A word's form is its near word of largest n (ties: the first in code-point order) if that is at
    least twice the word's own n, else null with a null form_n; root is the last form on the way, the word itself without a
    form.  n grows at every step, so the way ends.  Repeated rows count as often as they stand; tables without words give no
    rows; further columns are left out.
    """
    counted = checkpoint(words(df, id_col, text_col, least_length, least_count))
    near = near_words(counted, most)
    is_form = F.col("near_n") >= TIMES * F.col("n")
    joined = checkpoint(
        counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    )
    last = roots(joined.filter("form is not null"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words by what is left after one deletion; CRC-32 of few bytes at a time, for the small tables of the check only.
ORACLE = """with recursive runs as materialized (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as k
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) as r from documents) group by 1, 2),
bits as materialized (select list(c order by b) as t from (select b, list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b) as c from range(256) x(b))),
hashed as (select run, k, xor(list_reduce([('0x' || substr(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), (2 * i + 1)::int, 2))::bigint for i in range(octet_length(encode(coalesce(doc_id::varchar, '') || ':' || run)))],
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::bigint), 4294967295) as h from runs, bits),
counted as materialized (
  select word, sum(k)::bigint as n from (select k, case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= 5 group by word having sum(k) >= 3),
less as materialized (select distinct word, n, substr(word, 1, i::int) || substr(word, i::int + 2) as d, i from (select word, n, unnest(range(length(word))) as i from counted)),
near as (
  select distinct a.word as word, a.n as n, b.word as v, b.n as m from less a join counted b on a.d = b.word
  union select b.word, b.n, a.word, a.n from less a join counted b on a.d = b.word
  union select a.word, a.n, b.word, b.n from less a join less b on a.d = b.d and a.i = b.i where a.word <> b.word),
top as (select word, n, count(*) as n_near, max(m) as m, arg_min(v, (-m, v)) as v from near group by word, n),
formed as materialized (select c.word as word, c.n as n, coalesce(n_near, 0) as n_near, case when m >= 2 * c.n then v end as form, case when m >= 2 * c.n then m end as form_n from counted c left join top t on t.word = c.word),
walk as (select word, word as at, form as next from formed union all select w.word, f.word, f.form from walk w join formed f on f.word = w.next)
select f.word as word, form, w.at as root, n, n_near, form_n from formed f join walk w on w.word = f.word where w.next is null"""
