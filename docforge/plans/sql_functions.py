"""The engine's text functions under SQL names, and table functions over the rows of a partition."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import itemgetter

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docforge.functions import render, rules
from docforge.functions import text as T
from docforge.operators import exam
from docforge.operators.lines import column_table

NATIVE: dict[str, tuple[Callable[[Column], Column], str]] = {
    "normalize_line": (T.normalize_line, "STRING"),
    "split_fused": (T.split_fused, "STRING"),
    "redact_personal_data": (T.redact, "STRING"),
    "paragraph_key": (T.paragraph_key, "STRING"),
    "line_rule": (rules.rule_of, "STRING"),
    "line_tag": (rules.tag_of, "STRING"),
    "is_heading": (rules.is_heading, "BOOLEAN"),
    "word_count": (T.words, "INT"),
    "escape_typst": (render.escape_typst, "STRING"),
}


class ObjectiveQuestions:
    """(doc_id, q_num, q_id, images) of a document's blocks (doc_id, seq, kind, text, xref), which come in order: what
    exam.group_objective_questions gives, as a machine that holds one question. Use: objective_questions(TABLE(...)
    PARTITION BY doc_id ORDER BY seq)."""

    RETURNS = "doc_id bigint, q_num int, q_id string, images array<bigint>"
    HEAD, CHROME, BOTH, MARKED, ALONE, SERIAL = (re.compile(p) for p in (exam.OBJECTIVE, rules.PAGE_CHROME, exam.SERIAL_AND_ID, exam.ID_AND_MARKS, exam.ID_ONLY, exam.SERIAL_ONLY))

    def __init__(self) -> None:
        self.doc, self.n, self.is_open, self.at = None, 0, False, None

    def finished(self) -> Iterator[tuple]:
        if self.is_open and self.images:
            self.n += 1
            yield self.doc, self.n, self.ident, self.images

    def eval(self, row) -> Iterator[tuple]:
        if self.at is None:  # a look for a name in every row costs more than all else
            self.at = itemgetter(*map(list(row.__fields__).index, ("doc_id", "kind", "text", "xref")))
        self.doc, kind, text, xref = self.at(row)
        text = text or ""
        if kind == "text" and self.HEAD.search(text):
            yield from self.finished()
            self.is_open, self.ended, self.ident, self.images = True, False, "", []
        elif not self.is_open:
            return
        elif kind == "image":
            if xref is not None:
                self.images.append(xref)
        elif kind == "text" and not self.ended and not self.CHROME.search(text):
            both, ident = self.BOTH.search(text), self.MARKED.search(text) or self.ALONE.search(text)
            if both or ident:
                self.ident = both.group(2) if both else ident.group(1)
            self.ended = bool(both or ident) or not self.SERIAL.search(text)

    def terminate(self) -> Iterator[tuple]:
        yield from self.finished()


def register(spark: SparkSession) -> list[str]:
    """Names of the functions made: temporary SQL functions out of the same expressions (no Python runs in them), and
    column_table and objective_questions, which are Python."""
    for name, (make, kind) in NATIVE.items():
        plan = spark.sql("SELECT '' AS s LIMIT 0").select(make(F.col("s")).alias("x"))._jdf.queryExecution().analyzed()
        body = plan.expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
    spark.udf.register("column_table", lambda block: None if block is None else column_table([x for x in block.split("\n") if x.strip()]), "string")
    spark.udtf.register("objective_questions", F.udtf(ObjectiveQuestions, returnType=ObjectiveQuestions.RETURNS))
    return [*NATIVE, "column_table", "objective_questions"]
