"""Sequence operators: loops over ordered rows, as windows, or as folds where a decision depends on what was built so far."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docforge.functions import rules
from docforge.operators.columns import fresh
from docforge.operators.lineage import cut
from docforge.operators.scan import ASK, LEAST, Large, Reach, Running, chain, large_groups, scan, split_large


def rows_upto(by: list[str], *order: str):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lines_of(docs: DataFrame, text: str = "text", pattern: str = "\n") -> DataFrame:
    """(…, line_no, line): every document's lines with their places."""
    keep = [c for c in docs.columns if c != text]
    return docs.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(text, pattern)).alias("line_no", "line"))


def sessionise(rows: DataFrame, by: list[str], order: list[str], header: Column, group: str = "group_no", large: Large | None | object = ASK) -> DataFrame:
    """group_no: how many headers have come; 0 before the first."""
    return scan(rows, by, order, {group: Running(F.coalesce(header.cast("int"), F.lit(0)))}, large=large)


def carry_forward(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that was not null."""
    return scan(rows, by, order, {name: Running(value, "last")})


def changes(rows: DataFrame, by: list[str], order: list[str], key: list[str], name: str, large: Large | None | object = ASK) -> DataFrame:
    """name: whether a row is its group's first or differs from the one before in one of the key's columns."""
    held = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])
    return scan(rows, by, order, {name: Running(held, "last", before=True)}, large=large).withColumn(name, ~F.col(name).eqNullSafe(held))


def islands(rows: DataFrame, by: list[str], order: str, key: str, name: str = "run") -> DataFrame:
    """run: number of the stretch of equal keys that a row is in."""
    new, large = fresh(rows, "_new"), large_groups(rows, by)
    return sessionise(changes(rows, by, [order], [key], new, large), by, [order], F.col(new), name, large).drop(new)


def merge_runs(rows: DataFrame, by: list[str], order: str, key: str, text: str, merged: list[str], glue: str = " ") -> DataFrame:
    """(by, run, tag, content, n): stretches of merged tags become one row each; other rows stay alone."""
    new, large = fresh(rows, "_new"), large_groups(rows, by)
    marked = changes(rows, by, [order], [key], new, large).withColumn(new, F.col(new) | ~F.coalesce(F.col(key).isin(merged), F.lit(False))) if merged else rows.withColumn(new, F.lit(True))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), glue)
    return sessionise(marked, by, [order], F.col(new), "run", large).groupBy(*by, "run").agg(F.first(key).alias("tag"), joined.alias("content"), F.count("*").alias("n"))


def outside_fences(lines: DataFrame, by: list[str], order: str, line: str = "line", large: Large | None | object = ASK) -> DataFrame:
    """in_code by the parity of the fences so far; the fences themselves go."""
    f = fresh(lines, "_fence")
    marked = lines.withColumn(f, F.col(line).rlike(rules.FENCE))
    return scan(marked, by, [order], {"fences": Running(F.col(f).cast("int"))}, large=large).where(~F.col(f)).withColumn("in_code", F.col("fences") % 2 == 1).drop(f)


def tag_blocks(lines: DataFrame, by: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """(by, run, tag, content, n): code between fences and table rows in a row are one block; blank lines end a table and go."""
    large = large_groups(lines, by)
    marked = outside_fences(lines, by, order, line, large).withColumn("tag", F.when(F.col("in_code"), "code").when(F.trim(line) == "", "blank").otherwise(rules.tag_of(F.col(line))))
    marked = marked.withColumn("text", F.when(F.col("in_code"), F.rtrim(line)).otherwise(F.trim(line)))
    # code blocks of different fences, and tables with a blank line between, are different runs
    new = fresh(marked, "_new")
    marked = changes(marked, by, [order], ["tag", "fences"], new, large).withColumn(new, F.col(new) | ~F.coalesce(F.col("tag").isin("table", "code"), F.lit(False)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text"))), lambda x: x["text"]), "\n")
    return sessionise(marked, by, [order], F.col(new), "run", large).where("tag <> 'blank'").groupBy(*by, "run").agg(F.first("tag").alias("tag"), joined.alias("content"), F.count("*").alias("n"))


def latch(rows: DataFrame, by: list[str], order: list[str], hit: Column, name: str = "latched") -> DataFrame:
    """True from the first hit on. by: parts on their own, or a document for a latch across its parts."""
    return scan(rows, by, order, {name: Running(hit, "max")}).withColumn(name, F.coalesce(name, F.lit(False)))


def number(rows: DataFrame, by: list[str], order: list[str], name: str = "n", when: Column | None = None) -> DataFrame:
    """1..n, or the running count of the rows that count (null for the others)."""
    if when is None:
        return scan(rows, by, order, {name: Running(F.lit(1))}).withColumn(name, F.col(name).cast("int"))
    counts = fresh(rows, "_counts")
    marked = scan(rows.withColumn(counts, when), by, order, {name: Running(F.col(counts).cast("int"))})
    return marked.withColumn(name, F.when(F.col(counts), F.col(name))).drop(counts)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """1..n within each group, whatever its size, as a bigint. Rows equal in all of order get their numbers in any order."""
    return scan(rows, by, order, {name: Running(F.lit(1).cast("bigint"))})


def letter(n: Column) -> Column:
    """A for 1, B for 2 and so on."""
    return F.chr(n + 64)


def chunks_by_range(pages: Column, start: Column, size: int) -> Column:
    """Chunk of a page number, whether pages between are kept or not."""
    return (F.floor((pages - start) / size) + 1).cast("int")


def chunks_of_kept(pages: DataFrame, size: int, by: list[str] | None = None, page: str = "page_num") -> DataFrame:
    """Chunks of so many kept pages."""
    return numbered(pages, by or ["doc_id"], [page], "chunk_index").withColumn("chunk_index", (F.floor((F.col("chunk_index") - 1) / size) + 1).cast("int"))


def in_turn(rows: DataFrame, by: list[str], order: str, values: list[str], start: Callable[[], object], result: str, kind: str) -> DataFrame:
    """(by, order, result): a decision for each row that depends on those before it, made in one pass over sorted rows.

    start() gives a function from a row's values to its result; each group has its own. Rows are narrow, sorted by
    Spark (which spills) and streamed, so a group of any size takes the memory of one batch and time in proportion.
    """
    narrow = rows.select(*by, order, *values)
    n, out = len(by) + 1, {"int": pa.int32(), "boolean": pa.bool_()}[kind]
    schema = StructType([*(narrow.schema[c] for c in [*by, order]), *StructType.fromDDL(f"{result} {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            made = []
            for key, value in zip(zip(*columns[: n - 1]), zip(*columns[n:])):
                if key != now:
                    now, step = key, start()
                made.append(step(*value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, out)], [*by, order, result])

    return narrow.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, schema)


def pack(items: DataFrame, by: list[str], order: str, size: str, most: float, most_other: tuple[str, float] | None = None, least: int = LEAST) -> DataFrame:
    """(by, order, bin): consecutive items go together until the next would overflow; a larger item has a bin of its own.

    Sizes are whole or decimal numbers, not below 0, for groups that are cut into parts (scan.chain): the place where a bin
    overflows is then found by sums up to each item. Small groups are folded in one pass each.
    """
    sizes = [(size, most), *([most_other] if most_other else [])]
    limits = tuple(m for _, m in sizes)

    def start():
        now, used = 0, None

        def step(*sizes):
            nonlocal now, used
            if used is not None and any(u + s > m for u, s, m in zip(used, sizes, limits)):
                now, used = now + 1, None
            used = tuple(u + s for u, s in zip(used, sizes)) if used else sizes
            return now

        return step

    def folded(rows: DataFrame) -> DataFrame:
        return in_turn(rows, by, order, [s for s, _ in sizes], start, "bin", "int")

    narrow = items.select(*by, order, *[s for s, _ in sizes])
    large = large_groups(narrow, by, least)
    if large is None:
        return folded(narrow)
    few, many, g = split_large(narrow, by, large)
    many = cut(many.drop(g))
    sums = {f"_sum{k}": Running(F.col(s)) for k, (s, _) in enumerate(sizes)}
    reaches = [Reach(F.col(f"_sum{k}"), F.col(f"_sum{k}") - F.col(s) + m) for k, (s, m) in enumerate(sizes)]
    starts = chain(many, by, order, sums, reaches).withColumn("_start", F.lit(1))
    marked = many.join(starts, [*by, order], "left")
    return folded(few).unionByName(scan(marked, by, [order], {"bin": Running(F.coalesce("_start", F.lit(0)))}, least).select(*by, order, (F.col("bin") - 1).cast("int").alias("bin")))


def neighbours(rows: DataFrame, by: list[str], order: str, text: str, is_heading: Column, reach: int = 2, most: int = 1000) -> DataFrame:
    """before and after: texts of the rows around that are no headings, cut to so many characters."""
    w = Window.partitionBy(*by).orderBy(order)
    own = F.when(~is_heading, F.col(text))
    around = lambda a, b: F.substring(F.array_join(F.collect_list(own).over(w.rowsBetween(a, b)), " "), 1, most)
    return rows.withColumn("before", around(-reach, -1)).withColumn("after", around(1, reach))


def spaced(rows: DataFrame, by: list[str], order: str, apart: int, least: int = LEAST) -> DataFrame:
    """Rows that come so far behind the last kept one; the first is kept. order is a number. Large groups are cut into parts
    (scan.chain), small ones are folded."""

    def start():
        last = None

        def step(at):
            nonlocal last
            if last is None or at - last >= apart:
                last = at
                return True
            return False

        return step

    at, kept = fresh(rows, "_at"), fresh(rows, "_kept")

    def folded(places: DataFrame) -> DataFrame:
        return in_turn(places.withColumn(at, F.col(order)), by, order, [at], start, kept, "boolean").where(kept).select(*by, order)

    places = rows.select(*by, order).distinct()
    large = large_groups(places, by, least)
    if large is None:
        return rows.join(folded(places), [*by, order], "left_semi")
    few, many, g = split_large(places, by, large)
    starts = folded(few).unionByName(chain(many.drop(g), by, order, {}, [Reach(F.col(order), F.col(order) + apart, at=True)]))
    return rows.join(starts, [*by, order], "left_semi")


def join_continuations(lines: Column, most: int = 400) -> Column:
    """Paragraphs of an array of lines: a line joins what was built so far if that has no end mark and isn't long, the line
    begins like a continuation, and neither is a heading nor the line a list item."""

    def joins(before: Column, line: Column) -> Column:
        fits = F.length(before) + 1 + F.length(line) <= most
        return fits & line.rlike(r'^[a-z0-9(\["]') & ~before.rlike(r"[.!?;:]\s*$") & ~rules.is_heading(before) & ~rules.is_heading(line) & ~line.rlike(rules.LIST_ITEM)

    def step(out: Column, line: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        return F.when((F.size(out) > 0) & (last != "") & (line != "") & joins(F.rtrim(last), line), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.rtrim(last), F.lit(" "), line)))).otherwise(F.concat(out, F.array(line)))

    return F.aggregate(F.transform(lines, lambda x: F.trim(x)), F.array().cast("array<string>"), step)
