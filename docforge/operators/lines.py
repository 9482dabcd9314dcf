"""Cleaning of lines, sentences and pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import rules
from docforge.functions.stages import STAGES, Stage, finished
from docforge.functions.text import fragments, normalize_line, part_fused, redact, sentences, split_fused, strip
from docforge.operators.columns import fresh
from docforge.operators.dedup import keep_first
from docforge.operators.lineage import cut
from docforge.operators.sequence import join_continuations
from docforge.sources.sinks import ordered_text


def clean_lines(lines: DataFrame, line: str = "line", custom: list[str] | None = None) -> DataFrame:
    """rule, kept and clean (normalised; fused words of kept lines split) of every line; blank lines aren't kept."""
    norm, low = fresh(lines, "_norm"), fresh(lines, "_low")
    out = lines.withColumn(norm, normalize_line(F.col(line))).withColumn(low, F.lower(F.trim(norm)))
    out = out.withColumn("rule", rules.rule_of(F.col(norm), custom, F.col(low)))
    return out.withColumn("kept", F.col("rule").isNull() & (F.col(norm) != "")).withColumn("clean", F.when(F.col("kept"), split_fused(F.col(norm))).otherwise(F.col(norm))).drop(norm, low)


def settled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with these columns evaluated once: a filter on them stays above, else it would be pushed below and their
    expressions repeated in it wherever they stand."""
    held = fresh(df, "_held")
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*others, F.explode(F.array(F.struct(*columns))).alias(held)).select(*others, *[F.col(f"{held}.{c}") for c in columns])


def clean_pages(pages: DataFrame, text: str = "text", custom: list[str] | None = None) -> DataFrame:
    """pages with their text cleaned: blank-separated blocks that are column tables are rebuilt, other lines are cleaned,
    and every kept line is a paragraph. Array functions only: rows never meet."""
    blocks = F.filter(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n\s*\n"), lambda b: F.trim(b) != "")
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), normalize_line), lambda x: (x != "") & ~rules.drops_element(x, custom))
    rebuilt = F.transform(blocks, lambda b: F.struct(b.alias("b"), column_table_sql(b).alias("t")))
    kept = F.flatten(F.transform(rebuilt, lambda x: F.when(x["t"].isNotNull(), F.array(x["t"])).otherwise(F.transform(lines(x["b"]), split_fused))))
    return pages.withColumn(text, F.array_join(kept, "\n\n"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once: a plain expression is evaluated wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Lines of the least column table, and blanks between its columns.
ROWS, GAP = 3, 4


def column_table_sql(block: Column, rows: int = ROWS, gap: int = GAP) -> Column:
    """The block with bars between columns that all its lines leave blank for gap characters, or null. JVM functions only.

    A line is a number of as many bits as it has characters, sixty to a number, set where it isn't blank; the bits of all
    lines or-ed are the block's profile. Cuts are the middles of the blank stretches in it.
    """
    at_a_time = 60

    def profile_of(lines: Column) -> Column:
        bits = F.transform(lines, lambda x: F.translate(F.regexp_replace(x, "[^ ]", "1"), " ", "0"))
        parts = F.floor((F.array_max(F.transform(lines, lambda x: F.length(x))) - 1) / at_a_time).cast("int")
        piece = lambda x, i: F.conv(F.rpad(F.substring(x, i * at_a_time + 1, F.lit(at_a_time)), at_a_time, "0"), 2, 10).cast("bigint")
        merged = lambda xs, i: F.lpad(F.bin(F.aggregate(xs, F.lit(0).cast("bigint"), lambda n, x: n.bitwiseOR(piece(x, i)))), at_a_time, "0")
        joined = _let(bits, lambda xs: F.array_join(F.transform(F.sequence(F.lit(0), parts), lambda i: merged(xs, i)), ""))
        return F.rtrim(F.translate(joined, "01", " x"))

    def cuts_of(inks: Column) -> Column:
        # gaps lie between inked columns; leading blanks count as a gap too
        ends = F.aggregate(inks, F.array(F.lit(0)), lambda out, p: F.concat(out, F.array(F.get(out, F.size(out) - 1) + F.length(p))))
        blanks = F.transform(inks, lambda p: F.length(p) - F.length(F.ltrim(p)))
        return F.filter(F.zip_with(F.slice(ends, F.lit(1), F.size(inks)), blanks, lambda e, n: F.when(n >= gap, e + F.floor(n / 2).cast("int"))), lambda c: c.isNotNull())

    def table_of(lines: Column, bounds: Column) -> Column:
        cell = lambda line, i: F.trim(F.substring(line, F.get(bounds, i) + 1, F.coalesce(F.get(bounds, i + 1), F.length(line) + F.get(bounds, i)) - F.get(bounds, i)))
        return F.array_join(F.transform(lines, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.size(bounds) - 1), lambda i: cell(x, i)), " | ")), "\n")

    def rebuilt(lines: Column) -> Column:
        inks = F.regexp_extract_all(profile_of(lines), F.lit(r"( *x+)"), F.lit(1))
        bounds = F.concat(F.array(F.lit(0)), _let(inks, cuts_of))
        return F.when(F.size(lines) >= rows, _let(bounds, lambda b: F.when(F.size(b) >= 2, table_of(lines, b))))

    return _let(F.filter(F.split(block, "\n"), lambda x: F.trim(x) != ""), rebuilt)


def column_table(lines: list[str], rows: int = ROWS, gap: int = GAP, unique_header: bool = False) -> str | None:
    """The same of a list of lines in Python; unique_header also drops rows like the first, after which rows must remain."""
    if len(lines) < rows:
        return None
    inked = sorted({i for line in lines for i, c in enumerate(line) if c != " "})
    cuts, last = [], -1
    for i in inked:
        if i - last - 1 >= gap:
            cuts.append(last + 1 + (i - last - 1) // 2)
        last = i
    if not cuts:
        return None
    bounds = [0, *cuts]
    table = [[line[a:b].strip() for a, b in zip(bounds, [*cuts, max(len(line), cuts[-1])])] for line in lines]
    if unique_header:
        header = [c.lower() for c in table[0]]
        table = [table[0], *(r for r in table[1:] if [c.lower() for c in r] != header)]
        if len(table) < rows:
            return None
    return "\n".join(" | ".join(r) for r in table)


def column_tables(block: Column, unique_header: bool = True) -> Column:
    """column_table of a column of blocks, in Arrow batches: wide blocks cost more as nested array functions. Blocks of too
    few lines, or without so many blanks in a row as part columns, stay in the JVM."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: None if b is None else column_table([x for x in b.split("\n") if x.strip()], unique_header=unique_header))

    wide = F.contains(block, F.lit(" " * GAP)) & (F.length(block) - F.length(F.replace(block, F.lit("\n"))) >= ROWS - 1)
    return run(F.when(wide, block))


def header_key(line: Column) -> Column:
    """A line as table headers are told apart: lower case, no bars, single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.lower(line), F.lit("|")), r"[ \t\n\x0B\f\r](?:\s+|(?<! ))", " "))


def clean_pages_with_structure(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """(doc, page, text): the page cleaner that keeps line structure.

    Blank-separated blocks that are column tables are rebuilt (rows like the first go); lines are normalised and judged;
    a known table header is kept once a document, and no line that reads like the first row of a rebuilt table is kept on
    its later pages; continuations are joined; then blocks of few words, case headers and headings a page has had go,
    and blocks that have become column tables are rebuilt. Lines of a page meet again in one row, pages of a document never do.
    """
    blocks = F.filter(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n(?:[ \t]*\n)+"), lambda b: F.trim(b) != "")
    # dealt by page once, as raw text: all that is grouped by page below lies there already
    rows = pages.repartition(doc, page).select(doc, page, F.posexplode_outer(blocks).alias("block_no", "block"))
    rows = rows.withColumn("made", column_tables(F.col("block")))
    first = header_key(F.regexp_extract("block", r"^\s*([^\n]*)", 1))
    lined = rows.select(doc, page, "block_no", F.posexplode_outer(F.split(F.coalesce("made", "block"), "\n")).alias("line_no", "raw"), F.when(F.col("made").isNotNull(), first).alias("start"))
    lined = lined.withColumn("norm", normalize_line(F.col("raw"))).withColumn("low", F.lower(F.trim("norm")))
    judged = settled(lined.withColumn("rule", rules.rule_of(F.col("norm"), None, F.col("low"))), ["norm", "rule"])
    stays = F.col("raw").isNull() | (F.col("norm") == "") | F.col("rule").isNull()
    of_page = F.collect_list(F.when(stays, F.struct("block_no", "line_no", split_fused(F.col("norm")).alias("line"))))
    # lines are judged once; headers are looked for in what is left of them, and only keys' digests are shuffled for that
    listed = cut(judged.groupBy(doc, page).agg(F.array_sort(of_page).alias("xs"), F.collect_set("start").alias("starts")))
    at = lambda x: x["block_no"] * F.lit(1 << 20) + x["line_no"]
    lines = listed.select(doc, page, F.explode("xs").alias("x")).select(doc, page, at(F.col("x")).alias("at"), F.col("x.line").alias("line"), header_key(F.col("x.line")).alias("key"))
    digest = F.when(F.col("key") == "", "").otherwise(F.md5("key")).alias("key")
    keyed = lines.select(doc, page, "at", digest, F.coalesce(rules.is_table_header(F.col("line")), F.lit(False)).alias("known"))
    keyed = settled(keyed, ["key", "known"])
    starts = listed.select(doc, F.col(page).alias("first_page"), F.explode("starts").alias("key")).groupBy(doc, digest).agg(F.min("first_page").alias("first_page"))
    late = repeated_headers(keyed, starts, doc, page, "at", "key", F.col("known")).groupBy(doc, page).agg(F.collect_list("at").alias("late"))
    left = F.when(F.col("late").isNull(), F.col("xs")).otherwise(F.filter("xs", lambda x: ~F.array_contains("late", at(x))))
    left = F.transform(left, lambda x: F.struct(x["block_no"].alias("block_no"), F.coalesce(x["line"], F.lit("")).alias("line")))
    listed = settled(listed.join(late, [doc, page], "left").select(doc, page, left.alias("xs")), ["xs"]).where(F.size("xs") > 0)
    # a blank line between blocks, as on the page
    spaced = F.flatten(F.transform(F.sequence(F.lit(0), F.size("xs") - 1), lambda i: F.when((i > 0) & (F.get("xs", i)["block_no"] != F.get("xs", i - 1)["block_no"]), F.array(F.lit(""), F.get("xs", i)["line"])).otherwise(F.array(F.get("xs", i)["line"]))))
    joined = F.regexp_replace(F.array_join(join_continuations(spaced), "\n"), r"\n{3,}", "\n\n")
    paragraphs = listed.select(doc, page, F.posexplode_outer(F.split(strip(joined), "\n\n")).alias("n", "p"))
    one_line = strip(F.regexp_replace("p", r"\s*\n\s*", " "))
    paragraphs = paragraphs.withColumn("flat", one_line).withColumn("heading", rules.is_heading(F.col("flat")))
    heading_key = F.when(F.col("heading") & (F.length("flat") < 120), F.lower(F.regexp_replace("flat", r"\s+", " ")))
    # within a page, which is one row's lines: no key of all pages, and no shuffle
    again = F.row_number().over(Window.partitionBy(doc, page, "heading_key").orderBy("n"))
    paragraphs = paragraphs.withColumn("heading_key", heading_key).withColumn("again", again).where("again = 1 OR heading_key IS NULL")
    fine = (F.col("flat") != "") & ~F.col("flat").rlike(rules.CASE_HEADER) & rules.keeps_block(F.col("flat"))
    rebuilt = F.coalesce(column_tables(F.col("p")), F.col("p"))
    done = paragraphs.where(fine).select(doc, page, "n", rebuilt.alias("p")).groupBy(doc, page).agg(ordered_text(F.col("n"), F.col("p"), "\n\n").alias("t"))
    return pages.drop(text).join(done, [doc, page], "left").withColumn(text, F.coalesce("t", F.lit(""))).drop("t")


def met_headers(rows: DataFrame, starts: DataFrame, doc: str, page: str, order: str, key: str, known: Column, how: str) -> tuple[DataFrame, Column]:
    """(rows with the headers that their keys meet, whether a row repeats one)."""
    mark, met = fresh(rows, "_header"), fresh(rows, "_met")
    # blank lines, the commonest of all, meet no header: each gets a key that none has, so that they are no hot group
    heads = rows.withColumn(mark, known).withColumn(met, F.when(F.col(key) == "", F.concat(F.lit("\n"), F.xxhash64(page, order).cast("string"))).otherwise(F.col(key)))
    seen = keep_first(heads.where(F.col(mark)), [doc, key], [page, order]).select(doc, F.col(key).alias(met), F.struct(page, order).alias("_first"))
    both = seen.join(starts.withColumnRenamed(key, met), [doc, met], "full")
    late = F.coalesce(F.struct(F.col(page), F.col(order)) > F.col("_first"), F.lit(False)) | F.coalesce(F.col(page) > F.col("first_page"), F.lit(False))
    return heads.join(both, [doc, met], how).drop(mark, met), late & (F.col(key) != "")


def drop_repeated_headers(rows: DataFrame, starts: DataFrame, doc: str, page: str, order: str, key: str, known: Column) -> DataFrame:
    """Rows but those that repeat a header: a known header is seen at once, the first row of a table (starts: doc, key,
    first_page) from the next page on."""
    met, late = met_headers(rows, starts, doc, page, order, key, known, "left")
    return met.where(~late | (F.col(key) == "")).drop("_first", "first_page")


def repeated_headers(rows: DataFrame, starts: DataFrame, doc: str, page: str, order: str, key: str, known: Column) -> DataFrame:
    """The rows that drop_repeated_headers drops."""
    met, late = met_headers(rows, starts, doc, page, order, key, known, "inner")
    return met.where(late).drop("_first", "first_page")


def drop_artifacts(docs: DataFrame, generation: int, text: str = "text", first_part: Column | None = None) -> DataFrame:
    """Texts of finished books without chat, by the rules of one of three generations.

    1: lines that begin like chat go. 2: fragments (text.fragments) that hold some go. 3: the same by more rules, without
    personal data, with fused words parted; where first_part is true, its sentences are judged by a list of their own.
    """
    if generation == 1:
        kept = F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda x: (x != "") & ~x.rlike(r"(?i)^(?:" + "|".join(rules.BOOK_STARTS) + ")"))
        return docs.withColumn(text, F.array_join(kept, "\n"))
    squeezed = lambda x: strip(F.regexp_replace(F.translate(x, "\u00a0", " "), r"\s+", " "))
    if generation == 2:
        kept = F.filter(F.transform(fragments(F.col(text)), squeezed), lambda x: (x != "") & ~x.rlike(rules.search_pattern(rules.BOOK_SEARCH)))
        return docs.withColumn(text, F.array_join(kept, "\n"))
    normal = lambda x: squeezed(redact(F.regexp_replace(F.regexp_replace(x, r"([1-9])\x{20E3}", "$1."), r"\x{1F51F}", "10.")))
    bad = lambda x: F.lower(x).isin(rules.BOOK_EXACT) | x.rlike(r"^\d{1,2}\.\s*$") | x.rlike(rules.PIPE_ROW) | x.rlike(rules.search_pattern(rules.BOOK_SEARCH_MORE)) | x.rlike(rules.search_pattern(rules.SEARCH))
    kept = F.filter(F.transform(fragments(F.col(text)), normal), lambda x: (x != "") & ~bad(x))
    if first_part is not None:
        told = lambda x: F.array_join(F.filter(sentences(x), lambda s: (strip(s) != "") & ~s.rlike(rules.search_pattern(rules.BOOK_FIRST_PART))), " ")
        kept = F.when(F.coalesce(first_part, F.lit(False)), F.filter(F.transform(kept, told), lambda x: x != "")).otherwise(kept)
    return docs.withColumn(text, F.array_join(F.transform(kept, lambda x: part_fused(x)), "\n"))


def drop_chain(docs: DataFrame, stages: list[dict[str, str | None]], text: str = "text") -> DataFrame:
    """Stages of (paragraph, line, sentence) patterns: what matches at its level goes. Array functions, one pass a stage."""
    for stage in stages:
        kept = F.filter(F.split(F.col(text), r"\n{2,}"), lambda p: ~p.rlike(stage["paragraph"])) if stage.get("paragraph") else F.split(F.col(text), r"\n{2,}")
        lines = lambda p: F.filter(F.split(p, "\n"), lambda x: ~x.rlike(stage["line"])) if stage.get("line") else F.split(p, "\n")  # noqa: E731, B023
        parts = lambda x: F.array_join(F.filter(sentences(x), lambda s: ~s.rlike(stage["sentence"])), " ") if stage.get("sentence") else x  # noqa: E731, B023
        whole = F.transform(kept, lambda p: F.array_join(F.filter(F.transform(lines(p), parts), lambda x: strip(x) != ""), "\n"))
        docs = docs.withColumn(text, F.array_join(F.filter(whole, lambda p: p != ""), "\n\n"))
    return docs


# Structure lines of finished books.
STRUCTURE = r"(?i)\b(?:SECTION|MODULE|PART|FOUNDATION MODULE|THERAPEUTIC MODULE|PRACTICE MODULE|PROFESSIONAL TOOLKIT)\b"
ORPHAN_NUMBER = r"^\d+[.)]?$"


def drop_structure_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~x.rlike(STRUCTURE) & ~F.trim(x).rlike(ORPHAN_NUMBER)), "\n"))



def finish_book(paragraphs: DataFrame, text: str = "text", stages: tuple[Stage, ...] = STAGES, custom: tuple[str, ...] = ()) -> DataFrame:
    """Paragraphs that stay after all stages, in what is left of them. Each stage sees what the one before left; a paragraph
    that is null or that a stage drops goes. No shuffle; every stage is settled before the next reads it."""
    for stage in stages:
        paragraphs = settled(paragraphs.withColumn(text, finished(F.col(text), stage, custom)), [text]).where(F.col(text).isNotNull())
    return paragraphs
