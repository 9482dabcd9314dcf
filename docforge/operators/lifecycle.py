"""State changes as DataFrames: a table after an operation, never an update in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.operators.columns import fresh

# States of work that a restart finds unfinished.
IN_FLIGHT = ["QUEUED", "PROCESSING", "RUNNING", "IN_PROGRESS"]


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def start_jobs(documents: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents after it, refused): wanted ones start unless they already run."""
    asked = fresh(documents, "_asked")
    named = documents.join(wanted.select("document_id", F.lit(True).alias(asked)).distinct(), "document_id", "left")
    runs = F.col("status").isin(IN_FLIGHT)
    return named.withColumn("status", F.when(F.col(asked) & ~runs, "PROCESSING").otherwise(F.col("status"))).drop(asked), named.where(F.col(asked) & runs).select("document_id")


def progress(stage: Column, stages: Column, first: float = 15.0, span: float = 60.0) -> Column:
    """Percent at the beginning of a stage."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(first) + (stage - 1) / stages * F.lit(span)))


def chunk_progress(chunk: Column, chunks: Column) -> Column:
    """Percent when a chunk of so many is at work."""
    return progress(chunk + 1, chunks, 25.0, 60.0)


def document_status(stage_runs: DataFrame) -> DataFrame:
    """Status by its stages: failed if any is, ready if all are done, else processing."""
    return stage_runs.groupBy("document_id").agg(F.when(F.count_if(F.col("status") == "FAILED") > 0, "FAILED").when(F.count_if(F.col("status") != "COMPLETED") == 0, "READY").otherwise("PROCESSING").alias("status"))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of deleted documents."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def reset(tables: dict[str, DataFrame], again: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Parts, chunks, artefacts and events of documents that are planned anew go."""
    return {n: t for n, t in delete_documents(tables, again, key).items() if n in {"parts", "chunks", "artifacts", "events"}} | {n: t for n, t in tables.items() if n not in {"parts", "chunks", "artifacts", "events"}}


def clone_config(configs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Configs of (document_id, source_document_id) pairs: those of the source."""
    own = pairs.join(configs.withColumnRenamed("document_id", "source_document_id"), "source_document_id").drop("source_document_id")
    return upsert(configs, own, ["document_id"])


def crash_cleanup(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.withColumn(status, F.when(F.col(status).isin(IN_FLIGHT), "FAILED").otherwise(F.col(status)))


def archive(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    asked = fresh(documents, "_asked")
    named = documents.join(wanted.select("document_id", F.lit(True).alias(asked)).distinct(), "document_id", "left")
    return named.withColumn("status", F.when(F.col(asked), "ARCHIVED").otherwise(F.col("status"))).drop(asked)


def rerun_chunks(chunks: DataFrame, wanted: DataFrame, keep_text: bool = False) -> DataFrame:
    """The named chunks count one retry more and are pending; their text goes unless only the part is made anew."""
    asked = fresh(chunks, "_asked")
    named = chunks.join(wanted.select("chunk_id", F.lit(True).alias(asked)).distinct(), "chunk_id", "left")
    again = F.coalesce(asked, F.lit(False))
    text = F.col("text") if keep_text else F.when(~again, F.col("text"))
    return named.withColumn("retry_count", F.col("retry_count") + again.cast("int")).withColumn("status", F.when(again, "PENDING").otherwise(F.col("status"))).withColumn("text", text).drop(asked)


def merge_jobs_started(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Merge jobs with a new running one for each wanted document (job_id, document_id) that has none unfinished."""
    busy = jobs.where(F.col("status").isin(IN_FLIGHT)).select("document_id").distinct()
    return jobs.unionByName(wanted.join(busy, "document_id", "left_anti").select("job_id", "document_id", F.lit("RUNNING").alias("status")), allowMissingColumns=True)


def merge_jobs_after(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Merge jobs with what their run reported (job_id, ok)."""
    return jobs.join(finished, "job_id", "left").withColumn("status", F.when(F.col("ok"), "COMPLETED").when(~F.col("ok"), "FAILED").otherwise(F.col("status"))).drop("ok")
