"""Calls of an outside model: an injected callable, batches by budget, and what is done with its answers.

Nothing here opens a network connection; the default callable answers from the text alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions.render import keeps_facts, keeps_table, table_rows
from docforge.functions.text import tokens_estimate, words
from docforge.operators.layout import match_tables
from docforge.operators.sequence import neighbours, number, pack
from docforge.sources.sinks import ordered_text
from docforge.sources.tables import opening_pages

MOST_TOKENS, MOST_WORDS, MOST_BLOCKS, ATTEMPTS = 6000, 3000, 12, 6
BLOCK_TYPES = ["H1", "H2", "H3", "BODY", "LIST", "TABLE"]


class RateLimited(Exception):
    """The callable asks to be left alone for a while."""


def back_off(failures: int, limited: bool) -> float:
    """Seconds: twice as long after each failure, 60 at most after a rate limit and 30 after others."""
    return float(min(60 if limited else 30, 2**failures))


class Pool:
    """Providers in turn; one that fails rests, a success takes one failure off its count."""

    def __init__(self, providers: list[Callable[[str], str]], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.providers, self.attempts, self.sleep, self.clock = providers, attempts, sleep, clock
        self.failures, self.rests = [0] * len(providers), [0.0] * len(providers)

    def call(self, prompt: str) -> str:
        error: Exception | None = None
        for _ in range(self.attempts):
            k = min(range(len(self.providers)), key=lambda i: (max(0.0, self.rests[i] - self.clock()), i))
            if (wait := self.rests[k] - self.clock()) > 0:
                self.sleep(wait)
            try:
                answer = self.providers[k](prompt)
            except Exception as e:
                error = e
                self.failures[k] += 1
                self.rests[k] = self.clock() + back_off(self.failures[k], isinstance(e, RateLimited))
            else:
                self.failures[k] = max(0, self.failures[k] - 1)
                return answer
        raise error or RuntimeError("no provider")


class RotatingPool:
    """Accounts of one provider: a rate limit moves on to the next account and uses up no attempt, however often; any
    other failure does, and stays with the account."""

    def __init__(self, accounts: list[Callable[[str], str]], attempts: int = 5, sleep: Callable[[float], None] = time.sleep):
        self.accounts, self.attempts, self.sleep, self.now = accounts, attempts, sleep, 0

    def call(self, prompt: str) -> str:
        failed = 0
        while True:
            try:
                return self.accounts[self.now](prompt)
            except RateLimited:
                self.now = (self.now + 1) % len(self.accounts)
                self.sleep(2.0)
            except Exception:
                failed += 1
                if failed >= self.attempts:
                    raise
                self.sleep(1.0)


def batches(blocks: DataFrame, by: list[str], order: str = "seq", text: str = "text") -> DataFrame:
    """bin of each block, by tokens and words; rows of one table share a run and are one item."""
    n = words(F.col(text))
    items = blocks.groupBy(*by, "run").agg(F.min(order).alias("_first"), F.sum(tokens_estimate(n)).alias("tokens"), F.sum(n).alias("words"))
    return blocks.join(items.join(pack(items, by, "_first", "tokens", MOST_TOKENS, ("words", MOST_WORDS)), [*by, "_first"]).select(*by, "run", "bin"), [*by, "run"])


def label_and_rewrite(rows: DataFrame, key: str, text: str, model: Callable[[str], str]) -> DataFrame:
    """(key, answer, error) of each text, in Arrow batches; a text whose call fails has its error and no answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for t in frame[text]:
                try:
                    answers.append(model(t))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({key: frame[key], "answer": answers, "error": errors})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, answer string, error string")


def labelled(raw: Column) -> Column:
    """array<struct<block_type, needs_rewrite, text>> of lines "[TYPE|NR] text": lines without a tag go on with the block
    before, by a newline in tables and a blank elsewhere; unknown types are BODY."""
    form = r"^\s*\[([A-Za-z0-9]+)(\|NR)?\]\s*(.*)$"
    block = "struct<block_type:string,needs_rewrite:boolean,text:string>"

    def step(out: Column, line: Column) -> Column:
        kind = F.upper(F.regexp_extract(line, form, 1))
        new = F.struct(F.when(kind.isin(BLOCK_TYPES), kind).otherwise("BODY").alias("block_type"), (F.regexp_extract(line, form, 2) != "").alias("needs_rewrite"), F.regexp_extract(line, form, 3).alias("text"))
        last = F.get(out, F.size(out) - 1)
        more = F.struct(last["block_type"].alias("block_type"), last["needs_rewrite"].alias("needs_rewrite"), F.concat(last["text"], F.when(last["block_type"] == "TABLE", "\n").otherwise(" "), F.trim(line)).alias("text"))
        return F.when(F.trim(line) == "", out).when(line.rlike(form), F.concat(out, F.array(new))).when(F.size(out) == 0, out).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(more)))

    return F.aggregate(F.split(raw, "\n"), F.array().cast(f"array<{block}>"), step)


def label_paragraphs(paragraphs: DataFrame, model: Callable[[str], str], by: list[str], order: str = "seq", text: str = "text") -> DataFrame:
    """(by, seq, block_type, needs_rewrite, text, fallback): the first pass. Paragraphs go to the model in batches; its
    blocks come back in order, and tables that lost a cell are the original again. A batch whose call fails is its
    paragraphs as they are, as body."""
    binned = batches(paragraphs.withColumn("run", F.col(order)), by, order, text)
    prompt = ordered_text(F.col(order), F.col(text), "\n\n")
    sent = binned.groupBy(*by, "bin").agg(prompt.alias("prompt"), F.min(order).alias("first")).withColumn("batch", F.to_json(F.struct(*by, "bin")))
    answers = sent.join(label_and_rewrite(sent, "batch", "prompt", model), "batch")
    blocks = answers.where("error IS NULL").select(*by, "bin", F.posexplode(labelled(F.col("answer"))).alias("k", "b")).select(*by, "bin", "k", "b.*")
    cells = lambda t: F.array_distinct(F.filter(F.flatten(table_rows(t)), lambda c: F.length(c) >= 2))
    tables = blocks.where("block_type = 'TABLE'").select(*by, "bin", F.col("k").alias("table_no"), "text", cells(F.col("text")).alias("cells"))
    originals = binned.where(F.contains(text, F.lit("|"))).select(*by, "bin", F.col(order).alias("table_no"), F.col(text).alias("text"), cells(F.col(text)).alias("cells"))
    named = match_tables(tables, originals, [*by, "bin"]).join(originals.select(*by, "bin", F.col("table_no").alias("original_no"), F.col("text").alias("original_text")), [*by, "bin", "original_no"])
    told = blocks.join(named.select(*by, "bin", F.col("table_no").alias("k"), "original_text"), [*by, "bin", "k"], "left")
    lost = F.coalesce((F.col("block_type") == "TABLE") & ~keeps_table(F.col("original_text"), F.col("text")), F.lit(False))
    fine = told.select(*by, "bin", "k", "block_type", (F.col("needs_rewrite") & ~lost).alias("needs_rewrite"), F.when(lost, F.col("original_text")).otherwise(F.col("text")).alias("text"), lost.alias("fallback"))
    failed = binned.join(answers.where("error IS NOT NULL").select(*by, "bin"), [*by, "bin"], "left_semi")
    plain = failed.select(*by, "bin", F.col(order).alias("k"), F.lit("BODY").alias("block_type"), F.lit(False).alias("needs_rewrite"), F.col(text).alias("text"), F.lit(True).alias("fallback"))
    both = fine.unionByName(plain)
    return number(both, by, ["bin", "k"], "seq").drop("bin", "k")


def rewrite_flagged(blocks: DataFrame, model: Callable[[str], str], by: list[str], order: str = "seq") -> DataFrame:
    """blocks with rewritten and fallback: the second pass. Flagged blocks that are no tables go to the model with their
    neighbours; what loses a fact, or fails, stays as it was."""
    around = neighbours(blocks, by, order, "text", F.col("block_type").isin("H1", "H2", "H3"))
    flagged = around.where(F.col("needs_rewrite") & (F.col("block_type") != "TABLE"))
    context = F.substring(F.concat_ws(" ", F.nullif(F.col("before"), F.lit("")), F.nullif(F.col("after"), F.lit(""))), 1, 1000)
    asked = flagged.select(F.to_json(F.struct(*by, order)).alias("block"), *by, order, F.to_json(F.struct(F.when(context == "", "(none)").otherwise(context).alias("context"), "text")).alias("prompt"), F.col("text").alias("original_text"))
    answered = asked.join(label_and_rewrite(asked, "block", "prompt", model), "block").withColumn("new", F.trim("answer"))
    good = F.coalesce(keeps_facts(F.col("original_text"), F.col("new")), F.lit(False))
    done = answered.select(*by, order, F.when(good, F.col("new")).alias("new"), good.alias("rewritten"))
    told = blocks.join(done, [*by, order], "left")
    fallback = F.col("fallback") | F.coalesce(~F.col("rewritten"), F.lit(False))
    return told.withColumn("fallback", fallback).withColumn("rewritten", F.coalesce("rewritten", F.lit(False))).withColumn("text", F.coalesce("new", "text")).drop("new")


def transform(paragraphs: DataFrame, label: Callable[[str], str], rewrite: Callable[[str], str], by: list[str], order: str = "seq", text: str = "text") -> DataFrame:
    """Both passes."""
    return rewrite_flagged(label_paragraphs(paragraphs, label, by, order, text), rewrite, by)


def contents_prompt(pages: DataFrame, first: int = 30) -> DataFrame:
    """(doc_id, prompt): what a model is asked for a table of contents by: the opening pages and the form of the answer."""
    return opening_pages(pages, first).select("doc_id", F.concat(F.lit('List the chapters of this book as JSON: [{"page": 1, "title": "..."}]\n\n'), "text").alias("prompt"))


def salvage_json(raw: Column, schema: str) -> Column:
    """The answer as JSON, else what stands between its first [ and last ]."""
    return F.coalesce(F.from_json(raw, schema), F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), schema))


def chapters_answer(raw: Column, last_page: Column) -> Column:
    """Chapter starts that a model named: whole pages in range, titles cut to 120 characters, confidence 0.80."""
    found = salvage_json(raw, "array<struct<page:int,title:string>>")
    fine = F.filter(found, lambda c: c["page"].isNotNull() & (c["page"] >= 1) & (c["page"] <= last_page))
    return F.transform(fine, lambda c: F.struct(c["page"].alias("page"), F.substring(c["title"], 1, 120).alias("title"), F.lit(0.80).alias("confidence")))


def identity_labels(text: str) -> str:
    """The default callable: every line is body."""
    return "\n".join(f"[BODY] {line}" for line in text.split("\n") if line.strip())
