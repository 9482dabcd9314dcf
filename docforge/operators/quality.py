"""Data quality: record validators and checks of rewritten text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.operators.columns import fresh

EMAIL_FORM = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that is null counts as broken. One pass, no shuffle."""
    broken = F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(~c, F.lit(True)).alias("bad")) for n, c in rules.items()]), lambda r: r["bad"])
    return rows.select(key, F.explode(F.transform(broken, lambda r: r["rule"])).alias("rule"))


def length_within(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high)


def one_of(value: Column, names: list[str]) -> Column:
    return value.isin(names)


def ordered(start: Column, end: Column) -> Column:
    return end >= start


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL_FORM)


def allowed_keys(json_text: Column, allowed: list[str], required: list[str]) -> Column:
    keys = F.json_object_keys(json_text)
    return (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0) & (F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0)


def verify_rewrites(blocks: DataFrame, old: str = "original_text", new: str = "text") -> DataFrame:
    """Blocks with their rewriting kept where facts or tables survived, else reverted and marked as fallback."""
    from docforge.functions.render import keeps_facts, keeps_table

    fine = F.when(F.col("block_type") == "TABLE", keeps_table(F.col(old), F.col(new))).otherwise(keeps_facts(F.col(old), F.col(new)))
    fine = F.coalesce(fine, F.lit(False))
    ok = fresh(blocks, "_ok")
    return blocks.withColumn(ok, fine).withColumn("fallback", ~F.col(ok)).withColumn(new, F.when(F.col(ok), F.col(new)).otherwise(F.col(old))).drop(ok)


def transform_stats(blocks: DataFrame, per_batch: int = 12) -> DataFrame:
    """One row of counters: blocks, by kind, flagged, rewritten, fallbacks, and the batches the flagged ones take."""
    kinds = [F.count_if(F.col("block_type") == k).alias(f"n_{k.lower()}") for k in ("H1", "H2", "H3", "BODY", "LIST", "TABLE")]
    flagged = F.count_if("needs_rewrite")
    return blocks.agg(F.count("*").alias("blocks"), *kinds, flagged.alias("flagged"), F.count_if("rewritten").alias("rewritten"), F.count_if("fallback").alias("fallbacks"), F.ceil(flagged / per_batch).alias("rewrite_batches"))
