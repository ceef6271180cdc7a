"""Line dedup: lines found in many documents are dropped, reassembled by position.

All DataFrame operations.  Lines are hashed once; only a line's 128-bit key hash, never its text, is
shuffled to count documents, and counting is partially aggregated before the shuffle, so a line that a
third of all rows hold costs a few rows per task.  Keys found in enough rows go back to their lines:
by a broadcast below a checked number, and beyond it by a shuffled join but for the hottest keys
(``join_counted``), so that no key makes a task's rows.  Texts are shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import checkpoint, join_counted

#: White space stripped from a line's ends.
ENDS = " \t\n\x0b\x0c\r"
#: Keys (of some 40 bytes) that are broadcast at most.
MOST_KEYS = 1_000_000


def folded(line: Column) -> Column:
    """A line as the bytes of its UTF-8, each taken for a character and lower-cased.

    Two lines fold alike just if they are equal but for the case of A-Z: of the bytes beyond ASCII only
    leading ones have a lower case (C0 to DE have E0 to FE), and how many bytes follow one still tells them apart.
    """
    return F.lower(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1"))


def _on_keys(lines: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """lines with the columns of their key; keys: (on, n, ...), one row a key."""
    return lines.join(F.broadcast(keys.drop("n")), on) if keys.count() <= MOST_KEYS else join_counted(lines, keys, on, total)


def dedup_lines(df: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row: doc_id, n_lines long, n_dropped long, kept string; with ``carry`` also "rest", a struct of the other columns.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses all its
    lines but those of the largest doc_id that holds it.  Null and empty texts are one empty line;
    shorter keys always stay.  Repeated rows of one doc_id count as one document and all keep or
    lose the same lines; rows with a null doc_id are returned whole and not counted.
    """
    rest = [F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col))).alias("rest")] if carry else []
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *rest)
    lines = F.split("text", "\n", -1)
    docs = docs.withColumn("mark", F.xxhash64("text"))  # tells repeated ids apart

    # each step is made of the one before by a function's argument, so a line is stripped and folded once
    stripped = F.transform(lines, lambda line: F.btrim(line, F.lit(ENDS)))
    keys = F.transform(stripped, lambda line: F.when(F.length(line) >= min_chars, folded(line)))

    def placed_key(key: Column, place: Column) -> Column:
        """Place and two hashes with different seeds of a line that is long enough: a false meeting needs both to agree."""
        return F.when(key.isNotNull(), F.struct(place.alias("place"), F.xxhash64(key).alias("a"), F.xxhash64(F.lit(17), key).alias("b")))

    held = docs.filter("doc_id is not null").select("doc_id", "mark", F.array_compact(F.transform(keys, placed_key)).alias("keys"))
    held = checkpoint(held.filter(F.size("keys") > 0))
    # one hash is enough to leave out lines of few rows; distinct longs go through a hash set, so this is linear in the lines
    in_rows = held.select(F.explode(F.array_distinct(F.transform("keys", lambda k: k["a"]))).alias("a"))
    several = checkpoint(in_rows.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs))
    total = int(several.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    placed = held.select("doc_id", "mark", F.explode("keys").alias("key")).select("doc_id", "mark", "key.place", "key.a", "key.b")
    documents = _on_keys(placed.select("doc_id", "a", "b"), several, ["a"], total).distinct()
    common = checkpoint(documents.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs))
    drops = _on_keys(placed, common, ["a", "b"], total).filter(F.col("doc_id") < F.col("last")).groupBy("doc_id", "mark").agg(F.collect_set("place").alias("drops"))
    more = ["rest"] if carry else []
    joined = docs.join(drops, ["doc_id", "mark"], "left").select("doc_id", "drops", lines.alias("lines"), *more)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))  # by a hash set, so linear in the lines
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return joined.select("doc_id", "lines", kept.alias("kept"), *more).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept"),
        *more,
    )


ORACLE = r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
lines as (
  select doc_id, u.pos, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from docs, lateral (select unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos) u
),
common as (select key, max(doc_id) as last from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select l.doc_id, l.pos, l.line, (c.key is not null and l.doc_id < c.last) as dropped from lines l left join common c on l.key = c.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""
