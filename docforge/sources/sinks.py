"""Sinks: chunk, tagged and manifest JSON, markup fragments, books, archives and logs."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.operators.columns import fresh


def chunk_json(pages: DataFrame, per_chunk: int) -> DataFrame:
    """(doc_id, chunk_index, json): the kept pages, numbered densely, per_chunk in each. Pages are numbered over ranges of
    (doc_id, page_num), so that no task holds a whole document."""
    from docforge.operators.sequence import numbered

    n = fresh(pages, "_dense")
    rows = numbered(pages, ["doc_id"], ["page_num"], n)
    rows = rows.withColumn("chunk_index", (F.floor((F.col(n) - 1) / per_chunk) + 1).cast("int")).drop(n)
    return rows.groupBy("doc_id", "chunk_index").agg(F.to_json(F.struct(F.first("chunk_index").alias("chunk_index"), F.array_sort(F.collect_list(F.struct("page_num", "text"))).alias("pages"))).alias("json"))


def write_json(df: DataFrame, path: str, *by: str) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").json(path)


def fragments(blocks: DataFrame, merge_bodies: bool = True) -> DataFrame:
    """(doc_id, chunk_index, fragment): runs of body blocks joined by spaces, or each its own paragraph."""
    from docforge.operators.sequence import merge_runs

    rows = merge_runs(blocks, ["doc_id", "chunk_index"], "seq", "tag", "content", merged=["body"] if merge_bodies else [])
    return rows.groupBy("doc_id", "chunk_index").agg(ordered_text(F.col("run"), markup(F.col("tag"), F.col("content")), "\n\n").alias("fragment"))


def markup(tag: Column, content: Column) -> Column:
    """Typst lines: one, two or three = before headings, - before list items, a fence around code."""
    from docforge.functions.render import escape_typst

    safe = escape_typst(content)
    return F.when(tag == "H1", F.concat(F.lit("= "), safe)).when(tag == "H2", F.concat(F.lit("== "), safe)).when(tag == "H3", F.concat(F.lit("=== "), safe)).when(tag == "list", F.concat(F.lit("- "), F.regexp_replace(safe, r"^[-*•]\s*", ""))).when(tag == "code", F.concat(F.lit("```\n"), content, F.lit("\n```"))).otherwise(safe)


def ordered_text(order: Column, text: Column, glue: str) -> Column:
    """Aggregate: texts in order, joined; the shuffle may deliver them in any."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), glue)


def book(fragments: DataFrame, header: str = "") -> DataFrame:
    """(doc_id, book): the header and the fragments in chunk order."""
    return fragments.groupBy("doc_id").agg(F.concat(F.lit(header), ordered_text(F.col("chunk_index"), F.col("fragment"), "\n\n")).alias("book"))


def manifest(records: DataFrame) -> DataFrame:
    """(doc_id, json) of page records."""
    counts = records.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.array_sort(F.collect_list(F.struct("source_page", "cleaned_char_count", "kept"))).alias("pages"))
    return counts.select("doc_id", F.to_json(F.struct("total", "kept", (F.col("total") - F.col("kept")).alias("dropped"), "pages")).alias("json"))


def build_manifest(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, json) of a finished build: its pages, how many chunks, their files in order, and the merged files."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "path"))), lambda c: c["path"])
    told = documents.join(chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), parts.alias("parts")), "document_id", "left")
    fields = ["document_id", "total_pages", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("parts", F.array().cast("array<string>")).alias("parts"), "merged_typ", "compiled_pdf"]
    return told.select("document_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def library_record(results: DataFrame) -> DataFrame:
    """(id, json): the record of each finished paper, with its counts under stats."""
    stats = F.struct("source_pages", "questions_kept", "translations_removed", "sections_detected", "answers_matched", F.size("answers_missing").alias("answers_missing_count"), "answers_missing")
    named = F.coalesce("answer_subject", F.lit(None).cast("string"))
    record = F.struct("id", "created_at", "input_filename", "key_filename", "output_filename", F.col("answer_subject").isNotNull().alias("answers_attached"), named.alias("answer_subject"), stats.alias("stats"))
    return results.select("id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def library_listing(records: DataFrame, examples: int = 5) -> DataFrame:
    """One row: how many records, their bytes, and the first so many names by age (a preview: the limit is the feature)."""
    newest = F.slice(F.array_sort(F.collect_list(F.struct(F.col("created_at").alias("at"), F.col("output_filename").alias("name"))), lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).otherwise(F.when(a["name"] < b["name"], -1).otherwise(1))), 1, examples)
    few = records.orderBy(F.desc("created_at"), "output_filename").limit(examples).agg(newest.alias("x"))
    return records.agg(F.count("*").alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).crossJoin(F.broadcast(few.select(F.transform("x", lambda r: r["name"]).alias("examples"))))


def archives(files: DataFrame, archive: str = "archive", name: str = "name", content: str = "content", order: str = "order") -> DataFrame:
    """(archive, content): a ZIP of each archive's files, equal names told apart (unique_names). One archive is one file and
    so one row and one task; it holds what a user downloads at once."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in frame.sort_values("place").itertuples():
                z.writestr(r.archive_name, r.content)
        return pd.DataFrame({"archive": [frame["archive"].iloc[0]], "content": [out.getvalue()]})

    named = unique_names(files.select(F.col(archive).alias("archive"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"), F.col(order).alias("place")), "name", "place", ["archive"])
    return named.groupBy("archive").applyInPandas(run, "archive string, content binary")


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to a log; Spark's writer commits them as one batch."""
    events.write.mode("append").parquet(path)


def append_batch(events: DataFrame, path: str, batch: int | str) -> None:
    """Adds a batch of events to a log, once however often it is tried: a batch has a folder of its own, which it replaces.
    Readers see it as the column ``batch``."""
    events.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def artifact_rows(paths: DataFrame, kind: str) -> DataFrame:
    """Registry rows of written files: a DataFrame read with _metadata."""
    return paths.select(F.lit(kind).alias("artifact_type"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).distinct()


def unique_names(rows: DataFrame, name: str, order: str, by: list[str] | None = None) -> DataFrame:
    """archive_name: base_n.ext for the second and later rows of a name, however many have it."""
    from docforge.operators.sequence import numbered

    k = fresh(rows, "_nth")
    n = F.col(k) - 1
    base, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return numbered(rows, [*(by or []), name], [order], k).withColumn("archive_name", F.when(n > 0, F.concat(base, F.lit("_"), n.cast("string"), ext)).otherwise(F.col(name))).drop(k)


def event_log(events: DataFrame) -> DataFrame:
    """Messages in time order, one text per document."""
    return events.groupBy("document_id").agg(ordered_text(F.struct("created_at", "event_id"), F.col("message"), "\n").alias("log"))
