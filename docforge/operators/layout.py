"""Page layout: spans, rectangles, body sizes, tables in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions.render import item_type
from docforge.operators.columns import fresh


#: Letters of a short line by which it finds its blocks.
HEAD = 4


def overlaps(a: str, b: str) -> Column:
    """Open rectangles that share a point."""
    return (F.col(f"{a}.x0") < F.col(f"{b}.x1")) & (F.col(f"{b}.x0") < F.col(f"{a}.x1")) & (F.col(f"{a}.y0") < F.col(f"{b}.y1")) & (F.col(f"{b}.y0") < F.col(f"{a}.y1"))


def outside_tables(blocks: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that overlap no table of their page."""
    b, t = blocks.alias("b"), tables.alias("t")
    same = [F.col(f"b.{k}") == F.col(f"t.{k}") for k in keys]
    on = overlaps("b", "t")
    for s in same:
        on = on & s
    return b.join(t, on, "left_anti")


def upper_median(value: str, default: float = 12.0) -> Column:
    """Aggregate: the value at place n // 2 of the sorted list. Spark keeps one count for each different value: the first
    value that over half of the rows don't exceed is that one, of an even number of rows too."""
    return F.coalesce(F.expr(f"percentile_disc(0.5000000000001D) WITHIN GROUP (ORDER BY {value})").cast("double"), F.lit(default))


def average_median(value: Column, default: float = 11.0) -> Column:
    return F.coalesce(F.median(value), F.lit(default))


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """(…, line text, font_size, item_type, runs) of spans: the largest span tells a line's size, the page's median the body's."""
    body = spans.groupBy("doc_id", "page_num").agg(average_median(F.col("size")).alias("body"))
    run = F.struct("span_no", "text", "bold", "italic")
    lines = spans.groupBy("doc_id", "page_num", "block_no", "line_no").agg(F.array_sort(F.collect_list(run)).alias("runs"), F.max("size").alias("font_size"), F.min("y0").alias("y0"))
    lines = lines.withColumn("text", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    return lines.join(body, ["doc_id", "page_num"]).withColumn("item_type", item_type(F.col("text"), F.col("font_size"), F.col("body"))).drop("body")


def page_items(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines and tables of a page as one stream, by y alone; equal ones keep their order."""
    both = lines.unionByName(tables, allowMissingColumns=True)
    return both.withColumn("item_no", F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("y0", "block_no", "line_no")))


def _joined(letters: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(letters, start, n), "")


def _heads(letters: Column, lengths: Column) -> Column:
    """Every run of so many letters of a text, given as its letters."""
    return F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(letters) - n + 1, F.lit(1))), lambda i: _joined(letters, i, n))))


def annotate(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Each block of text (headings and tables have none) with the runs of the line it contains that has most runs, if any
    of them is emphasised; the first of equal ones.

    A block that contains a line contains its inner words whole, so lines of three words or more meet the blocks of their
    document that have their longest inner word. Shorter lines meet those that have their first four letters (all of a
    line of fewer), which are looked up among the blocks' runs of as many letters: work grows with the text. Only documents
    with such lines are cut so.
    """
    text, key = F.trim(F.coalesce("text", F.lit(""))), "_word"
    emphasised = F.exists("runs", lambda r: r["bold"] | r["italic"])
    parts = F.split(F.col("_text"), r"\s+")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    own = lines.where(emphasised).select("doc_id", "line_no", "runs", text.alias("_text")).where("_text <> ''").withColumn(key, longest)
    body = blocks.where(~F.upper(F.coalesce("tag", F.lit("")) if "tag" in blocks.columns else F.lit("")).isin("H1", "H2", "H3", "TABLE")).select("doc_id", "seq", "content")
    words = body.select("doc_id", "seq", F.explode(F.array_distinct(F.split("content", r"\s+"))).alias(key))
    few = own.where(F.col(key).isNull()).withColumn(key, _joined(F.split("_text", ""), F.lit(1), F.lit(HEAD)))
    lengths = few.groupBy("doc_id").agg(F.collect_set(F.length(key)).alias("_lengths"))
    cut = body.join(lengths.hint("merge"), "doc_id").withColumn("_letters", F.split("content", ""))
    heads = cut.select("doc_id", "seq", F.explode(F.array_distinct(_heads(F.col("_letters"), F.col("_lengths")))).alias(key))
    # merged, never broadcast: what blocks and lines hold alike is few bytes in a file and many on the driver
    told = lambda keys, some: keys.join(some.hint("merge"), ["doc_id", key]).select("doc_id", "seq", "line_no", "runs", "_text")
    met = told(words, own.where(F.col(key).isNotNull())).unionByName(told(heads, few))
    held = met.join(body.hint("merge"), ["doc_id", "seq"]).where(F.contains("content", "_text"))
    best = held.groupBy("doc_id", "seq").agg(F.max_by("runs", F.struct(F.size("runs"), -F.col("line_no"))).alias("runs"))
    return blocks.join(best.hint("merge"), ["doc_id", "seq"], "left")


def match_tables(rewritten: DataFrame, originals: DataFrame, by: list[str]) -> DataFrame:
    """The original table of the same batch that each rewritten one is of: equal text first, then the most cells in common,
    then the first. One without cells is taken only where there is no other; without any original there is none (null)."""
    shared = F.size(F.array_intersect("r.cells", "o.cells"))
    met = rewritten.alias("r").join(originals.alias("o").hint("merge"), [F.col(f"r.{k}") == F.col(f"o.{k}") for k in by], "left")
    best = F.max_by(F.col("o.table_no"), F.struct(F.col("r.text").eqNullSafe(F.col("o.text")), F.size("o.cells") > 0, shared, -F.col("o.table_no")))
    return met.groupBy(*[F.col(f"r.{k}").alias(k) for k in by], F.col("r.table_no").alias("table_no")).agg(best.alias("original_no"))


def pair_by_text(a: DataFrame, b: DataFrame, text: str, order_a: str, order_b: str) -> DataFrame:
    """The n-th row of a text with the n-th of the other side: each is used once."""
    n = fresh(a, "_rn")
    rank = lambda df, o: df.withColumn(n, F.row_number().over(Window.partitionBy(text).orderBy(o)))
    return rank(a, order_a).join(rank(b, order_b), [text, n], "left").drop(n)
