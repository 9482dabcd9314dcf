"""Catalogue, listing and review: latest rows, versions, roll-ups, queues, orders and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.operators.columns import fresh
from docforge.operators.dedup import keep_first
from docforge.operators.scan import Running, scan
from docforge.operators.sequence import numbered


def latest(rows: DataFrame, by: list[str], *newest: str) -> DataFrame:
    """The newest row of each group; the last column named settles ties."""
    return keep_first(rows, by, [F.desc(c) for c in newest])


def current_version(versions: DataFrame, section: str = "section_id", version: str = "version", edited: str = "is_edited") -> DataFrame:
    """The largest version among edited ones, else the largest."""
    return keep_first(versions, [section], [F.desc(edited), F.desc(version)])


def next_version(versions: DataFrame, section: str = "section_id") -> DataFrame:
    return versions.groupBy(section).agg((F.max("version") + 1).alias("next_version"))


def rollup(rows: DataFrame, by: list[str], status: str, names: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(F.col(status) == n).alias(n.lower()) for n in names], F.count("*").alias("total"))


def approved(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col(status).isin("APPROVED", "LOCKED")).alias("approved"), F.count("*").alias("total"))


def page_of(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a listing (the limit is the feature) with the count of all rows, which is taken before the cut."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), 200)).crossJoin(F.broadcast(total))


def matches(name: Column, q: str) -> Column:
    """Anywhere in the name whatever its case; % and _ in q are wild, as in the listing it serves."""
    return name.ilike(f"%{q}%")


def status_is(status: Column, wanted: str | None) -> Column:
    return F.lit(True) if not wanted or wanted.upper() == "ALL" else F.upper(status) == wanted.upper()


def in_order_of(rows: DataFrame, wanted: DataFrame, key: str, pos: str, then: str, by: list[str] | None = None) -> DataFrame:
    """position: asked-for rows in that order, the others behind in their own; unknown keys are ignored. by: what one
    list is about, such as a document; without it all rows are one list, numbered over many partitions."""
    joined = rows.join(wanted, key, "left")
    if by:
        return joined.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(pos).isNull(), pos, then, key)))
    last = fresh(joined, "_last")
    return numbered(joined.withColumn(last, F.col(pos).isNull()), [], [last, pos, then, key], "position").drop(last)


def only_in_order_of(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted, key)


def reorder(sections: DataFrame, wanted: DataFrame, key: str = "section_id") -> DataFrame:
    """section_order of the named sections becomes their place, from 1."""
    at = fresh(sections, "_pos")
    return sections.join(wanted.select(key, F.col("pos").alias(at)), key, "left").withColumn("section_order", F.coalesce(F.col(at) + 1, F.col("section_order"))).drop(at)


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Parents with an array of their children in order."""
    fields = [c for c in children.columns if c != key]
    kids = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in fields]))).alias(name))
    return parents.join(kids, key, "left")


def merge_gate(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, incomplete, without_output, parts, ok)."""
    out = chunks.groupBy(doc).agg(F.count_if(F.col("status") != "COMPLETED").alias("incomplete"), F.count_if((F.col("status") == "COMPLETED") & F.col("output").isNull()).alias("without_output"), F.count("output").alias("parts"))
    return out.withColumn("ok", (F.col("incomplete") == 0) & (F.col("without_output") == 0) & (F.col("parts") >= 1))


def assembly_gate(drafts: DataFrame, sections: DataFrame, override: bool = False) -> DataFrame:
    """(document_id, open_sections, allowed) by each document's newest draft."""
    now = latest(drafts, ["document_id"], "created_at", "draft_id")
    counts = sections.groupBy("draft_id").agg(F.count_if(~F.col("status").isin("APPROVED", "LOCKED")).alias("open_sections"))
    return now.join(counts, "draft_id", "left").select("document_id", F.coalesce("open_sections", F.lit(0)).alias("open_sections"), ((F.coalesce("open_sections", F.lit(0)) == 0) | F.lit(override)).alias("allowed"))


def review_queue(drafts: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections of the newest drafts that await review, with their chunks' status."""
    now = latest(drafts, ["document_id"], "created_at", "draft_id").select("document_id", "draft_id")
    return sections.join(now, "draft_id").where(~F.col("status").isin("APPROVED", "LOCKED")).join(chunks.select("chunk_id", F.col("status").alias("chunk_status")), "chunk_id", "left")


def review_state(actions: DataFrame, by: list[str], order: list[str], action: str = "action") -> DataFrame:
    """(by, status, flagged): the fold of edit, approve, lock, flag and unlock.

    A locked section takes nothing but unlock, so what counts is the last action that had an effect: everything between
    a lock and the next unlock has none. An edit of an approved section sets it back to reviewed.

    The lock that holds at each action is scanned over parts of large sections' logs; the rest are aggregates, which are
    made before the shuffle. So one section may hold most actions.
    """
    lock = fresh(actions, "_lock")
    marks = scan(actions, by, order, {lock: Running(F.when(F.col(action).isin("lock", "unlock"), F.col(action)), "last", before=True)})
    live = (F.coalesce(lock, F.lit("unlock")) != "lock") | (F.col(action) == "unlock")
    status = F.when(live, F.when(F.col(action) == "approve", "APPROVED").when(F.col(action) == "lock", "LOCKED").when(F.col(action).isin("flag", "unlock", "edit"), "REVIEWED"))
    flagged = F.when(live, F.when(F.col(action) == "flag", True).when(F.col(action) == "approve", False))
    newest = lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))
    return marks.groupBy(*by).agg(F.coalesce(newest(status), F.lit("PENDING")).alias("status"), F.coalesce(newest(flagged), F.lit(False)).alias("flagged"))


def health(documents: DataFrame, chunks: DataFrame, ready: list[str]) -> DataFrame:
    """One row of system counts."""
    d = documents.agg(F.count_if(F.col("status") == "PROCESSING").alias("processing"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status").isin(ready)).alias("ready"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "FAILED").alias("failed_chunks"))
    return d.crossJoin(F.broadcast(c))


def output_files(pages: Column, per_file: Column, chapters: Column | None = None) -> Column:
    """Files that a document will give: by pages, or where there are chapters by how many of mean length fit in one."""
    by_pages = F.ceil(pages / per_file).cast("int")
    if chapters is None:
        return by_pages
    fit = F.greatest(F.lit(1), F.floor(per_file / (pages / F.nullif(chapters, F.lit(0)))))
    return F.when(chapters > 0, F.ceil(chapters / fit).cast("int")).otherwise(by_pages)


def dashboard(documents: DataFrame) -> DataFrame:
    """One row: queued, processing, ready and all documents."""
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    return documents.agg(n("UPLOADED", "QUEUED").alias("queued"), n("PROCESSING").alias("processing"), n("READY", "MERGE_READY").alias("ready"), F.count("*").alias("total"))


def page_window(pages: Column, at: Column, reach: int = 2) -> Column:
    """Whether a page is one of those that a preview links from the page it shows."""
    return pages.between(at - reach, at + reach)
