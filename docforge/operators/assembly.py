"""Books out of chunks: raw, structured and ready for publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import render, rules
from docforge.operators.columns import fresh
from docforge.operators.scan import Running, same, scan
from docforge.operators.sequence import latch, letter, number, numbered
from docforge.sources.sinks import ordered_text


def chunk_text(cleaned: Column, raw: Column) -> Column:
    """The cleaned text, else the raw one."""
    return F.coalesce(F.nullif(F.trim(cleaned), F.lit("")), raw, F.lit(""))


def split_appendix(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.withColumn("is_appendix", rules.is_appendix(F.col(text)))


def raw_merge(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): completed chunks in order."""
    return chunks.where(F.col("status") == "COMPLETED").groupBy("doc_id").agg(ordered_text(F.col("chunk_index"), F.col("text"), "\n\n").alias("text"))


def numbered_sections(chunks: DataFrame) -> DataFrame:
    """(doc_id, section_order, section_type, n, title, text): front matter, body chunks as chapters, appendices, back matter.

    n: chapters and appendices are numbered in chunk order among their own kind. One scan gives both numbers, chapters first:
    a chapter's place is its number, an appendix's less the chapters before it. The fixed sections' places are a count.
    """
    at, chapters = fresh(chunks, "_at"), fresh(chunks, "_chapters")
    done = split_appendix(chunks.where(F.col("status") == "COMPLETED"))
    appendix = F.coalesce(F.col("is_appendix"), F.lit(False))
    rows = done.withColumn("section_type", F.when(appendix, "appendix").otherwise("chapter")).withColumn("rank", appendix)
    rows = scan(rows, ["doc_id"], ["rank", "chunk_index"], {at: Running(F.lit(1).cast("bigint")), chapters: Running((~F.col("rank")).cast("bigint"))})
    rows = rows.withColumn("n", F.when(F.col("rank"), F.col(at) - F.col(chapters)).otherwise(F.col(at)).cast("int"))
    found = F.coalesce(render.heading_title(F.col("text")), F.concat(F.lit("Chapter "), F.col("n").cast("string")))
    title = F.when(F.col("rank"), F.concat(F.lit("Appendix "), letter(F.col("n")))).otherwise(found)
    rows = rows.select("doc_id", (F.col(at) + 1).alias("section_order"), "section_type", "n", title.alias("title"), render.upper_headings(F.col("text")).alias("text"))
    docs = chunks.where(F.col("status") == "COMPLETED").groupBy("doc_id").agg(F.count("*").alias(at))
    fixed = lambda at, kind: docs.select("doc_id", at.cast("bigint").alias("section_order"), F.lit(kind).alias("section_type"), F.lit(1).alias("n"), F.initcap(F.lit(kind.replace("_", " "))).alias("title"), render.front_matter(F.lit(kind), F.lit(kind)).alias("text"))
    return fixed(F.lit(1), "front_matter").unionByName(rows).unionByName(fixed(F.col(at) + 2, "back_matter"))


def structured(chunks: DataFrame) -> DataFrame:
    """(doc_id, section_order, section_type, title, text): the numbered sections."""
    return numbered_sections(chunks).drop("n")


def publication(chunks: DataFrame) -> DataFrame:
    """The structured sections, chapters behind a banner with their number."""
    rows = numbered_sections(chunks).withColumn("chapter_no", F.when(F.col("section_type") == "chapter", F.col("n").cast("bigint"))).drop("n")
    return rows.withColumn("text", F.when(F.col("section_type") == "chapter", F.concat(render.chapter_banner(F.col("chapter_no"), F.col("title")), F.col("text"))).otherwise(F.col("text")))


def export_plan(sections: DataFrame) -> DataFrame:
    """chapter_no and page_break of the sections that are exported: front matter and empty ones aren't, the first chapter has no break."""
    rows = sections.where((F.col("section_type") != "front_matter") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    rows = number(rows, ["doc_id"], ["section_order"], "chapter_no", F.col("section_type") == "chapter")
    return rows.withColumn("page_break", F.coalesce(F.col("chapter_no") > 1, F.lit(True)))


def split_at_appendix(lines: DataFrame, by: list[str], order: list[str], line: str = "line", anywhere: bool = False) -> DataFrame:
    """in_appendix of each line: from the first appendix head on, in the part or in the whole document, as by says."""
    return latch(lines, by, order, rules.begins_appendix(F.col(line), anywhere), "in_appendix")


def section_lines(lines: DataFrame, by: list[str], order: str, line: str = "line") -> DataFrame:
    """kind of each line of a section: a line is H1 if the next one is a rule of =, H2 if it is one of -, and that rule is
    used up (kind fence). Where rules follow each other, what is left of them heads and underlines in turn, as in a reading
    from above; a blank line above a rule uses it up and draws nothing (skip), a page mark doesn't. Other rules are fences."""
    s = F.trim(F.coalesce(F.col(line), F.lit("")))
    n, rule, last, nxt, odd = (fresh(lines, c) for c in ("_n", "_rule", "_last", "_next", "_odd"))
    marked = lines.withColumn(rule, F.when(s.rlike(render.H1_RULE), "H1").when(s.rlike(render.H2_RULE), "H2"))
    marked = numbered(marked, by, [order], n)
    text = F.when(F.col(rule).isNull(), F.struct(F.col(n).alias("n"), (~s.rlike(render.PAGE_MARK)).cast("bigint").alias("uses")))
    # rules between a line and the last text, less the one that this text used up: every second one is used up again
    marked = scan(marked, by, [order], {last: Running(text, "last")})
    behind = F.col(n) - F.coalesce(F.col(f"{last}.n"), F.lit(0)) - 1 - F.coalesce(F.col(f"{last}.uses"), F.lit(0))
    marked = marked.withColumn(odd, F.col(rule).isNotNull() & (F.pmod(behind, F.lit(2)) == 1))
    # the next line's rule, as a row of the line before it: numbers make both rows' keys equal
    below = marked.where(F.col(rule).isNotNull()).select(*by, (F.col(n) - 1).alias(n), F.col(rule).alias(nxt))
    told = marked.alias("r").join(below.alias("b"), same("r", "b", [*by, n]), "left").select("r.*", nxt)
    heads = F.col(nxt).isNotNull() & ~F.col(odd) & ~s.rlike(render.PAGE_MARK)
    kind = F.when(F.col(odd), "fence").when(heads, F.when(s == "", "skip").otherwise(F.col(nxt))).otherwise(render.line_kind(s))
    return told.withColumn("kind", kind).drop(n, rule, last, nxt, odd)


def profile_update(profiles: DataFrame, changes: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Settings with those changed that a change names; defaults where there was no profile."""
    both = profiles.alias("p").join(changes.alias("c"), "document_id", "full")
    return both.select("document_id", *[F.coalesce(f"c.{k}", f"p.{k}", F.lit(v)).alias(k) for k, v in defaults.items()])
