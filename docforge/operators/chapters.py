"""Chapters and chunks: detection, ends, packing and safe cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions.render import heading_confidence
from docforge.operators.columns import fresh
from docforge.operators.layout import upper_median
from docforge.operators.sequence import pack

PREAMBLE = "Preamble"
#: Page numbers of a cell, as a power of two.
CELL = 8


def body_size(spans: DataFrame, sample_pages: int = 20) -> DataFrame:
    """(doc_id, median) by the sizes on pages taken at even steps."""
    last = spans.groupBy("doc_id").agg(F.max("page_num").alias("last"))
    step = F.greatest(F.floor(F.col("last") / sample_pages), F.lit(1))
    taken = spans.join(last, "doc_id").where(((F.col("page_num") - 1) % step == 0) & (F.length(F.trim("text")) > 3) & (F.col("size") > 0))
    return taken.groupBy("doc_id").agg(upper_median("size").alias("median"))


def boundaries(spans: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, page, title, confidence): the surest heading of each page, the first of equal ones."""
    medians = body_size(spans)
    known = spans.join(medians, "doc_id", "left").withColumn("confidence", heading_confidence(F.col("text"), F.col("size"), F.coalesce("median", F.lit(12.0)), F.col("y0") / F.col("page_height")))
    n = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy(F.desc("confidence"), "seq"))
    return known.where(F.col("confidence") >= least).withColumn("n", n).where("n = 1").select("doc_id", F.col("page_num").alias("page"), F.trim("text").alias("title"), "confidence")


def ranges(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_start, page_end, title): a chapter ends before the next; a preamble where the first starts later."""
    last = pages.groupBy("doc_id").agg(F.max("page_num").alias("last"), F.min("page_num").alias("first"))
    w = Window.partitionBy("doc_id").orderBy("page")
    own = starts.join(last, "doc_id").select("doc_id", F.col("page").alias("page_start"), F.coalesce(F.lead("page").over(w) - 1, F.col("last")).alias("page_end"), "title")
    head = starts.groupBy("doc_id").agg(F.min("page").alias("page")).join(last, "doc_id").where("page > first").select("doc_id", F.col("first").alias("page_start"), (F.col("page") - 1).alias("page_end"), F.lit(PREAMBLE).alias("title"))
    return head.unionByName(own)


def split_long(chapters: DataFrame, most: int) -> DataFrame:
    """Chapters of more than so many pages in parts, the later ones marked as continued."""
    parts = F.explode(F.sequence(F.col("page_start"), F.col("page_end"), F.lit(most))).alias("at")
    return chapters.select("doc_id", "page_start", "page_end", "title", parts).select("doc_id", F.col("at").alias("page_start"), F.least(F.col("at") + most - 1, F.col("page_end")).alias("page_end"), F.when(F.col("at") > F.col("page_start"), F.concat("title", F.lit(" (continued)"))).otherwise(F.col("title")).alias("title"))


def pack_chapters(chapters: DataFrame, most: int) -> DataFrame:
    """(doc_id, chunk_index, page_start, page_end, title): chapters in a row share a chunk while their pages fit."""
    parts = split_long(chapters, most).withColumn("pages", F.col("page_end") - F.col("page_start") + 1)
    packed = pack(parts, ["doc_id"], "page_start", "pages", most)
    together = parts.join(packed, ["doc_id", "page_start"]).groupBy("doc_id", "bin").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min_by("title", "page_start").alias("a"), F.max_by("title", "page_start").alias("b"), F.count("*").alias("n"))
    return together.select("doc_id", (F.col("bin") + 1).alias("chunk_index"), "page_start", "page_end", F.when(F.col("n") == 1, F.col("a")).otherwise(F.concat_ws(" – ", "a", "b")).alias("title"))


def chunk_of_page(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each page with the first chunk that holds its number. Chunks are laid over cells of 2 ** CELL page numbers, so the join
    is on equal keys and there is a row a cell, not a page number: long gaps between pages cost little. Sides that grow with
    the input are sorted and merged, never broadcast: runs of numbers are few bytes in a shuffle and many on the driver."""
    cell, held, p = fresh(pages, "_cell"), fresh(pages, "_held"), F.col("page_num").cast("bigint")
    of = lambda c: F.shiftright(F.col(c).cast("bigint"), CELL)
    laid = chunks.where("page_start <= page_end").select("doc_id", F.explode(F.sequence(of("page_start"), of("page_end"))).alias(cell), F.struct("chunk_index", "page_start", "page_end").alias("c"))
    there = laid.groupBy("doc_id", cell).agg(F.collect_list("c").alias(held))
    met = pages.withColumn(cell, of("page_num")).join(there.hint("merge"), ["doc_id", cell], "left")
    mine = F.filter(held, lambda c: (c["page_start"] <= p) & (p <= c["page_end"]))
    return met.withColumn("chunk_index", F.array_min(F.transform(mine, lambda c: c["chunk_index"]))).drop(cell, held)


def continues_table(pages: DataFrame) -> DataFrame:
    """continues: the page begins with table rows, and the one before ended with some."""
    row = r"^\s*(\|.*\||\S+(\s{3,}\S+){2,})\s*$"
    first, last = F.split(F.trim("text"), "\n")[0], F.element_at(F.split(F.trim("text"), "\n"), -1)
    w = Window.partitionBy("doc_id").orderBy("page_num")
    return pages.withColumn("_last", last.rlike(row)).withColumn("continues", first.rlike(row) & F.coalesce(F.lag("_last").over(w), F.lit(False))).drop("_last")


def safe_cuts(pages: DataFrame, cuts: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, cut, safe): the first page from a cut on that continues no table, but not beyond the next chapter's start."""
    # from the last page on: a frame that runs to the end would be read anew for every row
    w = Window.partitionBy("doc_id").orderBy(F.desc("page_num")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = continues_table(pages).join(starts.select("doc_id", F.col("page").alias("page_num"), F.lit(True).alias("chapter")), ["doc_id", "page_num"], "left")
    marked = marked.withColumn("next_free", F.min(F.when(~F.col("continues") | F.coalesce("chapter", F.lit(False)), F.col("page_num"))).over(w))
    return cuts.join(marked.select("doc_id", F.col("page_num").alias("cut"), "next_free"), ["doc_id", "cut"], "left").select("doc_id", "cut", F.coalesce("next_free", "cut").alias("safe"))


def from_contents(entries: DataFrame, total: Column, least: int = 5, most: int = 300) -> DataFrame:
    """(doc_id, title, start_page, end_page, parts): chapters of a table of contents, at least so many pages apart, long ones in
    so many even parts, a row each."""
    from docforge.operators.sequence import spaced

    kept = spaced(entries, ["doc_id"], "start_page", least)
    w = Window.partitionBy("doc_id").orderBy("start_page")
    ends = kept.withColumn("end_page", F.coalesce(F.lead("start_page").over(w) - 1, total)).withColumn("pages", F.col("end_page") - F.col("start_page") + 1)
    # an entry behind the last page is one part of no pages; how many parts its pages come to is not above 0 there
    parts = ends.withColumn("parts", F.ceil(F.col("pages") / most).cast("int")).withColumn("each", F.coalesce(F.ceil(F.try_divide("pages", "parts")).cast("int"), F.lit(0)))
    each = parts.select("doc_id", "title", "parts", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1)).alias("k"), "each", "start_page", "end_page")
    return each.select("doc_id", "title", (F.col("start_page") + F.col("k") * F.col("each")).alias("start_page"), F.least(F.col("start_page") + (F.col("k") + 1) * F.col("each") - 1, F.col("end_page")).alias("end_page"), "parts")


def equal_chapters(pages: DataFrame, share: int = 50, least: int = 5) -> DataFrame:
    """The fallback: chapters of max(least, pages / share) pages."""
    n = pages.groupBy("doc_id").agg(F.max("page_num").alias("last"))
    size = F.greatest(F.floor(F.col("last") / share).cast("int"), F.lit(least))
    return n.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("last").cast("int"), size)).alias("page_start"), size.alias("s"), "last").select("doc_id", "page_start", F.least(F.col("page_start") + F.col("s") - 1, F.col("last")).alias("page_end"))


def needs_model(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, needed): fewer boundaries than max(3, 3 a hundred pages)."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return total.join(n, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) < F.greatest(F.lit(3), F.floor(F.col("pages") / 100) * 3)).alias("needed"))
