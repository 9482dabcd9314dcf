"""Answer keys: pages of tokens to (subject, question id, answer) rows, with the tokens nothing was made of."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import answers as A
from docforge.functions import rules
from docforge.functions.text import strip
from docforge.operators.dedup import last_wins
from docforge.operators.lineage import cut
from docforge.operators.sequence import carry_forward, in_turn

# Headers of subjects, by how surely they are one, and forms of ids.
SUBJECT_CODE = r"(?i)Subject\s*:\s*\(\s*(\d+)\s*\)\s*([A-Z][A-Z &,/\-]+?)(?:\s{2,}|\n|CSIR|FINAL|QUESTION\s*ID|$)"
SUBJECT_ABBREVIATED = r"(?i)Subject\s*:\s*\n?\s*([A-Z]{2,4})\s*[-‐–—]\s*([A-Z][A-Z &,/\-]+?)(?:\s{2,}|\n|$)"
SUBJECT_NUMBERED = r"(?i)Subject\s*:\s*\n?\s*(\d{3})\s*[-‐–—]\s*([A-Z][A-Z0-9 &,/\-]+?)(?:\s{2,}|\n|$)"
SUBJECT_ALONE = r"(?i)Subject\s*:\s*([A-Z][A-Z][A-Z &,/\-]+?)(?:\s{2,}|\n|$)"
SUBJECT_NAMED = r"(?m)Subject\s*:\s*([A-Za-z][A-Za-z &\-]+?)\s*$"
LONG_ID, SHORT_ID = r"^\d{6,}\z", r"^\*?(\d{1,4})\z"
LISTED_ANSWER = r"(?i)^(?:\d{1,5}(?:\s*,\s*\d{1,5})*|Dropped|\d{1,5}\(English\)/Dropped\(Hindi\)|Dropped\(English\)/\d{1,5}\(Hindi\))\z"
COLUMN_HEADERS = ["Option ID", "OPTION ID", "Correct Option ID", "CORRECT OPTION ID", "Key", "KEY", "Correct Key", "CORRECT KEY"]


def tokens(text: Column) -> Column:
    """Pieces of each line between runs of two blanks or more."""
    return F.filter(F.flatten(F.transform(F.split(text, "\n"), lambda x: F.transform(F.split(strip(x), r"\s{2,}"), strip))), lambda t: t != "")


def subject_of(text: Column) -> Column:
    """struct(code, name, short) of a page's header, null if it has none; headers without "(NNN)" come with short ids."""
    pick = lambda p, code, name, short: F.when(text.rlike(p), F.struct((F.regexp_extract(text, p, code) if code else F.lit("")).alias("code"), strip(F.regexp_extract(text, p, name)).alias("name"), F.lit(short).alias("short")))
    return F.coalesce(pick(SUBJECT_CODE, 1, 2, False), pick(SUBJECT_ABBREVIATED, 1, 2, True), pick(SUBJECT_NUMBERED, 1, 2, True), pick(SUBJECT_ALONE, 0, 1, True), pick(SUBJECT_NAMED, 0, 1, True))


def with_subjects(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages without a header go on with the last subject."""
    return carry_forward(pages, [doc], ["page_num"], subject_of(F.col("text")), "subject")


def _long_id_roles():
    """Of each token in turn: -1 for nothing, else twice its entry's number, one more for an answer's token."""
    entry, state = -1, "id"

    def step(token: str, is_id: bool, option_page: bool) -> int:
        nonlocal entry, state
        if state == "more" and not re.fullmatch(r"[0-9]{6,},*", token):
            state = "id"
        if state == "more":
            state = "more" if token.endswith(",") else "id"
            return 2 * entry + 1
        if is_id and (state == "id" or not option_page):
            entry, state = entry + 1, "answer"
            return 2 * entry
        if state == "answer":
            state = "more" if option_page and re.fullmatch(r"[0-9]{6,},", token) else "id"
            return 2 * entry + 1
        return -1

    return step


def pair_long_ids(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page_num, entry_no, subject, question_id, answer): each long id and the next token that is no page chrome.

    An id that another follows has no answer (null), but on pages whose answers are option ids, which look alike; there
    an id that ends in a comma goes on with the next ones.
    """
    pages = with_subjects(pages, doc).withColumn("option_page", F.col("text").rlike("Correct Option ID|CORRECT OPTION ID"))
    rows = pages.select(doc, "page_num", "subject", "option_page", F.posexplode(tokens(F.col("text"))).alias("n", "token"))
    rows = rows.where(~rules.is_key_noise(F.col("token"))).withColumn("is_id", F.col("token").rlike(LONG_ID))
    roles = in_turn(rows, [doc, "page_num"], "n", ["token", "is_id", "option_page"], _long_id_roles, "role", "int").where("role >= 0")
    rows = rows.join(roles, [doc, "page_num", "n"]).withColumn("entry_no", F.floor(F.col("role") / 2)).withColumn("answers", F.col("role") % 2 == 1)
    found = F.transform(F.array_sort(F.collect_list(F.when(F.col("answers"), F.struct("n", "token")))), lambda x: x["token"])
    made = rows.groupBy(doc, "page_num", "entry_no").agg(F.first("subject").alias("subject"), F.max(F.when(~F.col("answers"), F.col("token"))).alias("question_id"), found.alias("found"), F.first("option_page").alias("option_page"))
    ids = F.transform("found", lambda t: F.rtrim(F.regexp_replace(t, ",+$", "")))
    option_ids = F.col("option_page") & (F.size("found") > 0) & F.forall("found", lambda t: t.rlike(r"^\d{6,},*\z"))
    raw = F.array_join(ids, ", ")
    kind = F.when((F.size("found") == 1) & ~F.contains(F.col("found")[0], F.lit(",")), "single").otherwise("multi")
    by_option = F.struct(raw.alias("raw"), kind.alias("kind"), F.transform(ids, lambda t: t.cast("int")).alias("options"))
    return made.select(doc, "page_num", "entry_no", "subject", "question_id", F.get("found", F.lit(0)).alias("raw"), F.when(option_ids, by_option).otherwise(A.classify(F.get("found", F.lit(0)))).alias("answer"))


def _pairs():
    """Whether a line is the first of a pair, when each pair takes two lines."""
    taken = False

    def step(fits: bool) -> bool:
        nonlocal taken
        taken = bool(fits) and not taken
        return taken

    return step


def _pair(rows: DataFrame, doc: str, fits: Column) -> DataFrame:
    following = Window.partitionBy(doc, "page_num").orderBy("n")
    rows = rows.withColumn("raw", F.lead("line").over(following)).withColumn("fits", F.coalesce(fits, F.lit(False)))
    first = in_turn(rows, [doc, "page_num"], "n", ["fits"], _pairs, "first", "boolean").where("first").select(doc, "page_num", "n")
    return rows.join(first, [doc, "page_num", "n"]).select(doc, "page_num", F.col("n").cast("bigint").alias("entry_no"), "subject", F.regexp_replace("line", r"^\*", "").alias("question_id"), "raw")


def _lines(pages: DataFrame, doc: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    return pages.where("subject IS NOT NULL").select(doc, "page_num", "subject", F.posexplode(lines).alias("n", "line"))


def pair_lines(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page_num, entry_no, subject, question_id, raw) of lines that are an id with an answer behind, two at a time;
    pages that don't name their subject are left out."""
    own = F.when(F.col("text").rlike(SUBJECT_NAMED), F.struct(F.upper(F.regexp_extract("text", SUBJECT_NAMED, 1)).alias("code"), F.regexp_extract("text", SUBJECT_NAMED, 1).alias("name"), F.lit(True).alias("short")))
    return _pair(_lines(pages.withColumn("subject", own), doc), doc, F.col("line").rlike(SHORT_ID) & F.col("raw").rlike(LISTED_ANSWER))


def pair_short_ids(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The same behind the first column header of a page, where any whole number of up to seven digits is an id."""
    rows = _lines(with_subjects(pages, doc), doc)
    header = F.col("line").isin(COLUMN_HEADERS)
    seen = F.coalesce(F.max(header).over(Window.partitionBy(doc, "page_num").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    has = F.coalesce(F.max(header).over(Window.partitionBy(doc, "page_num")), F.lit(False))
    rows = rows.withColumn("data", seen | ~has).where("data")
    return _pair(rows, doc, F.col("line").rlike(r"^\d{1,7}\z") & ~rules.is_key_noise(F.col("line")) & ~rules.is_key_noise(F.col("raw")))


def sniff(pages: DataFrame) -> DataFrame:
    """(doc_id, listed): whether the key is one of printed lines: no "(NNN)" header, a "Subject:" trailer and the column title on its first three pages."""
    early = pages.where("page_num <= 3")
    has = lambda p: F.max(F.col("text").rlike(p))
    return early.groupBy("doc_id").agg((~has(SUBJECT_CODE) & has(SUBJECT_NAMED) & has("Correct Option ID")).alias("listed"))


def parse(pages: DataFrame) -> DataFrame:
    """(doc_id, subject, question_id, raw, kind, options) of all keys, each by the parser its form asks for: printed lines,
    short ids behind a header without a code, or long ids in running tokens."""
    forms = with_subjects(pages.join(sniff(pages), "doc_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False))))
    short = F.max(F.coalesce("subject.short", F.lit(False))).over(Window.partitionBy("doc_id"))
    # read by three parsers, and what they give is read again by reports: both are written once
    forms = cut(forms.withColumn("short", short))
    chosen = lambda c: forms.where(c).drop("subject", "short", "listed")
    parts = [
        pair_long_ids(chosen("NOT listed AND NOT short")),
        pair_short_ids(chosen("NOT listed AND short")).withColumn("answer", A.classify_short(F.col("raw"))),
        pair_lines(chosen("listed")).withColumn("answer", A.classify_listed(F.col("raw"))),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return cut(both.select("doc_id", "page_num", "entry_no", "subject", "question_id", F.coalesce("answer.raw", "raw").alias("raw"), F.coalesce("answer.kind", F.lit("unrecognised")).alias("kind"), F.coalesce("answer.options", F.array().cast("array<int>")).alias("options")))


#: Kinds of answers that nothing was made of: none behind an id, or one of no known form.
UNREAD = ["unrecognised", "unknown"]


def warnings(entries: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(subject, entries, unrecognised, duplicates, warning)."""
    counts = entries.groupBy("subject").agg(F.count("*").alias("entries"), F.count_if(F.col("kind").isin(UNREAD)).alias("unrecognised"))
    doubled = duplicates.groupBy("subject").agg(F.count("*").alias("duplicates"))
    out = counts.join(doubled, "subject", "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))
    return out.withColumn("warning", F.when((F.col("unrecognised") > 0) | (F.col("duplicates") > 0), F.format_string("%s unrecognised, %s duplicated of %s", F.col("unrecognised").cast("string"), F.col("duplicates").cast("string"), F.col("entries").cast("string"))))


def entries_of(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, log) of what parse gives: of each subject's repeated ids the last, and each overwriting. Ids without an
    answer are no entries."""
    named = parsed.withColumn("code", F.coalesce("subject.code", F.lit(""))).withColumn("code", F.when(F.col("code") == "", F.col("subject.name")).otherwise(F.col("code")))
    return last_wins(named.where(F.col("kind") != "unrecognised"), ["doc_id", "code", "question_id"], ["page_num", "entry_no"], "raw")


def key_report(parsed: DataFrame) -> DataFrame:
    """(doc_id, code, name, entries, unrecognised, duplicates, warnings) of each subject of a key."""
    entries, log = entries_of(parsed)
    code = F.when(F.coalesce("subject.code", F.lit("")) == "", F.col("subject.name")).otherwise(F.col("subject.code"))
    every = parsed.groupBy("doc_id", code.alias("code")).agg(F.min("subject.name").alias("name"), F.count_if(F.col("kind").isin(UNREAD)).alias("unrecognised"))
    out = every.join(entries.groupBy("doc_id", "code").agg(F.count("*").alias("entries")), ["doc_id", "code"], "left").join(log.groupBy("doc_id", "code").agg(F.count("*").alias("duplicates")), ["doc_id", "code"], "left")
    zero = F.lit(0).cast("bigint")
    out = out.select("doc_id", "code", "name", F.coalesce("entries", zero).alias("entries"), "unrecognised", F.coalesce("duplicates", zero).alias("duplicates"))
    told = [
        F.when(F.col("unrecognised") > 0, F.format_string("Subject %s (%s): %s unrecognised answer token(s)", "code", "name", F.col("unrecognised").cast("string"))),
        F.when(F.col("duplicates") > 0, F.format_string("Subject %s: %s duplicate question id(s) overwritten", "code", F.col("duplicates").cast("string"))),
    ]
    return out.withColumn("warnings", F.array_compact(F.array(*told)))
