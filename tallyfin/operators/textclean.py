"""Clean-up of paged documents: repeated headers and footers, headings, tables as markdown, and a quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfin.session import checkpoint, small

#: White space, as a set of characters and as a class of expressions; a filing's item heading, a broken glyph, and line ends.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HEADING = rf"(?i)^item{SPACE}+[0-9]+[a-z]?\.?{SPACE}*[^\n]+"
GLYPH = r"\(cid:\d+\)"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last empty line does not count."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, pos, line): every line in its place from 0.  pages: (doc, page, text)."""
    return pages.select("doc", "page", F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc").agg(F.count("*").alias("pages"))


def repeated_lines(pages: DataFrame, share: float = 0.6, least: int = 3, min_page_count: int | None = None) -> DataFrame:
    """(doc, line, pages): stripped lines on at least max(least, int(share * pages)) pages; a page counts once, documents of fewer than three pages have none.

    ``min_page_count`` sets the number of pages outright.  Lines are counted by a hash first, partially aggregated before
    the shuffle; only those found often enough are shuffled with their text to be counted by page.
    """
    lines = page_lines(pages).select("doc", "page", stripped(F.col("line")).alias("line")).filter("line <> ''").withColumn("h", F.xxhash64("doc", "line"))
    often = checkpoint(lines.groupBy("h").count().filter(F.col("count") >= (min_page_count or least)).select("h"))
    seen = lines.join(small(often), "h", "left_semi").select("doc", "page", "line").distinct()
    counted = seen.groupBy("doc", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= (min_page_count or least))  # few are left to meet their document
    of = page_counts(pages).select("doc", F.col("pages").alias("of"))
    needed = F.lit(min_page_count) if min_page_count else F.greatest(F.lit(least), F.floor(F.col("of") * share))
    return counted.join(of, "doc").filter((F.col("of") >= 3) & (F.col("pages") >= needed)).select("doc", "line", "pages")


def strip_repeated(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, page, pos, line) without the repeated ones, which are few: up to MOST_BROADCAST of them are broadcast, so that no line is shuffled."""
    gone = small(checkpoint(repeated.select(F.col("doc").alias("_doc"), F.col("line").alias("_line"))))
    lines = page_lines(pages)
    return lines.join(gone, (lines["doc"] == gone["_doc"]) & (stripped(lines["line"]) == gone["_line"]), "left_anti")


def mark_heading(line: Column) -> Column:
    return F.when(stripped(line).rlike(HEADING), F.concat(F.lit("## "), stripped(line))).otherwise(line)


def table_markdown(rows: Column) -> Column:
    """Markdown of an array of arrays of cells: a head, a rule, the rest; '' for fewer than two rows.  Null cells are empty, line feeds become spaces."""
    cell = lambda c: F.replace(stripped(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    head = F.element_at(rows, 1)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 1)), line)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 2, F.lit("")).otherwise(F.array_join(F.concat(F.array(line(head), rule), body), "\n"))


def assemble(pages: DataFrame, lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc, markdown) of every document of ``pages``: (doc, page, ...).

    lines: (doc, page, pos, line), what is left of the pages' text; tables: (doc, page, pos, rows).  A
    page gives its stripped lines, unless nothing is left, then each table of two rows or more after an
    empty part, then an empty part; parts are joined by an empty line, and the whole is stripped and
    ends in a line feed.  So a document without any text is one line feed.
    """
    text = lines.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", mark_heading(F.col("line")).alias("line")))).alias("ls"))
    text = text.select("doc", "page", stripped(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text")).filter("text <> ''")
    made = pages.select("doc", "page").distinct().join(text, ["doc", "page"], "left")
    none = F.array().cast("array<string>")
    if tables is None:
        made = made.withColumn("tables", none)
    else:
        shown = tables.select("doc", "page", "pos", table_markdown(F.col("rows")).alias("table")).filter("table <> ''")
        shown = shown.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "table"))).alias("ts"))
        shown = shown.select("doc", "page", F.flatten(F.transform("ts", lambda t: F.array(F.lit(""), t["table"]))).alias("tables"))
        made = made.join(shown, ["doc", "page"], "left")
    parts = F.concat(F.when(F.col("text").isNull(), none).otherwise(F.array("text")), F.coalesce("tables", none), F.array(F.lit("")))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", parts.alias("parts")))), lambda x: x["parts"]))
    return made.groupBy("doc").agg(F.concat(stripped(F.array_join(ordered, "\n\n")), F.lit("\n")).alias("markdown"))


def broken_glyph_pages(pages: DataFrame, pattern: str = GLYPH) -> DataFrame:
    return pages.filter(F.col("text").rlike(pattern)).select("doc", "page")


def quality_report(pages: DataFrame, tables: DataFrame | None = None, low_share: float = 0.15, low_least: float = 200.0, glyph: str = GLYPH) -> DataFrame:
    """(doc, pages, avg_chars, n_tables, low_text_pages, cid_pages, warnings): page numbers in order.

    A page has little text under ``low_share`` of its document's mean, where that exceeds ``low_least``.
    tables: (doc, page, rows), a row for each table.
    """
    of = pages.groupBy("doc").agg(F.count("*").alias("pages"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("avg_chars"))
    chars = F.length(F.coalesce("text", F.lit("")))
    low = (chars < F.col("avg_chars") * low_share) & (F.col("avg_chars") > low_least)
    met = pages.join(of, "doc").groupBy("doc", "pages", "avg_chars").agg(
        F.array_sort(F.collect_list(F.when(low, F.col("page")))).alias("low_text_pages"), F.array_sort(F.collect_list(F.when(F.col("text").rlike(glyph), F.col("page")))).alias("cid_pages")
    )
    if tables is None:
        met = met.withColumn("n_tables", F.lit(0).cast("long"))
    else:
        met = met.join(tables.groupBy("doc").agg(F.count("*").alias("n_tables")), "doc", "left").withColumn("n_tables", F.coalesce("n_tables", F.lit(0)))
    said = F.array_compact(F.array(
        F.when(F.size("low_text_pages") > 0, F.concat(F.lit("little text on pages "), F.array_join(F.col("low_text_pages").cast("array<string>"), ", "))),
        F.when(F.size("cid_pages") > 0, F.concat(F.lit("broken glyphs on pages "), F.array_join(F.col("cid_pages").cast("array<string>"), ", "))),
    ))
    return met.select("doc", "pages", "avg_chars", "n_tables", "low_text_pages", "cid_pages", F.array_join(said, "; ").alias("warnings"))
