"""Answers of exam keys: classification, display and resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docforge.functions.text import strip

NO_OPTIONS = "array<int>"

# What is printed where there is no option to print.
DROPPED = "Question dropped (all candidates awarded marks)"
NOT_FOUND = "Answer key not found for this question"


def _answer(raw: Column, kind: str, options: Column | None = None) -> Column:
    return F.struct(raw.alias("raw"), F.lit(kind).alias("kind"), (options if options is not None else F.array()).cast(NO_OPTIONS).alias("options"))


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def classify(raw: Column) -> Column:
    """struct(raw, kind, options): single, multi (sorted, distinct), or (in order), drop, unknown; null for blank cells."""
    s = strip(raw)
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit(None))
        .when(s.rlike(r"^[1-9]\z"), _answer(s, "single", _numbers(s)))
        .when(s.rlike(r"^[1-9](?:\s*,\s*[1-9])+\z"), _answer(s, "multi", F.array_sort(F.array_distinct(_numbers(s)))))
        .when(s.rlike(r"(?i)^[1-9]\s+or\s+[1-9]\z"), _answer(s, "or", _numbers(s)))
        .when(s.rlike(r"(?i)^drop\z"), _answer(F.lit("Drop"), "drop"))
        .otherwise(_answer(s, "unknown"))
    )


def classify_short(raw: Column) -> Column:
    """Keys of short ids: option ids of up to five digits; a star alone, or with only blanks, drops the question."""
    s = strip(raw)
    t = strip(F.regexp_replace(s, r"\*+\z", ""))
    many = F.array_sort(F.array_distinct(_numbers(t)))
    all_of_them = _answer(F.lit("* (marks awarded to all)"), "drop")
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit(None))
        .when(s.isin("*", "(*)") | (t == ""), all_of_them)
        .when(t.rlike(r"(?i)^drop(?:ped)?\z"), _answer(F.lit("Dropped"), "drop"))
        .when(t.rlike(r"^\d{1,5}\z"), _answer(t, "single", _numbers(t)))
        .when(t.rlike(r"^\d{1,5}(?:\s*,\s*\d{1,5})+,?\z"), _answer(F.array_join(many.cast("array<string>"), ", "), "multi", many))
        .when(t.rlike(r"(?i)^\d{1,5}\s+or\s+\d{1,5}\z"), _answer(t, "or", _numbers(t)))
        .otherwise(_answer(t, "unknown"))
    )


def classify_listed(raw: Column) -> Column:
    """Keys printed as id and answer lines: lists of digits, Dropped, else unknown (partial drops among them)."""
    s = strip(F.coalesce(raw, F.lit("")))
    many = F.array_sort(F.array_distinct(_numbers(s)))
    return (
        F.when(s == "", _answer(F.lit(""), "unknown"))
        .when(s.rlike(r"(?i)^dropped\z"), _answer(F.lit("Dropped"), "drop"))
        .when(s.rlike(r"^\d+(?:\s*,\s*\d+)*\z") & (F.size(many) == 1), _answer(many[0].cast("string"), "single", many))
        .when(s.rlike(r"^\d+(?:\s*,\s*\d+)*\z"), _answer(F.array_join(many.cast("array<string>"), ", "), "multi", many))
        .otherwise(_answer(s, "unknown"))
    )


def show(answer: Column) -> Column:
    """What is printed in the answer box."""
    listed = lambda glue: F.array_join(answer["options"].cast("array<string>"), glue)
    return (
        F.when(answer["kind"] == "single", F.concat(F.lit("Correct Option: "), listed("")))
        .when(answer["kind"] == "multi", F.concat(F.lit("Correct Options: "), listed(", "), F.lit("  (multiple correct)")))
        .when(answer["kind"] == "or", F.concat(F.lit("Correct Option: "), listed(" or "), F.lit("  (either accepted)")))
        .when(answer["kind"] == "drop", F.lit(DROPPED))
        .otherwise(F.concat(F.lit("Answer (raw): "), answer["raw"]))
    )


def resolve(raw: Column, kind: Column, options: Column) -> Column:
    """struct(text, found) of an answer against options array<struct<number, option_id>>.

    A single digit from 1 to 4 is an option's number. Otherwise each piece (split at commas, blanks and "or") that is all
    digits is an option id; ids that no option has are only reported if none has any; several numbers are sorted.
    """
    s = strip(F.coalesce(raw, F.lit("")))
    pieces = F.filter(F.split(s, r"(?i)[,\s]+|\bor\b"), lambda p: p.rlike(r"^\d+\z"))
    lookup = lambda p: F.get(F.filter(options, lambda o: o["option_id"] == p), F.lit(0))["number"]
    hits = F.filter(F.transform(pieces, lookup), lambda n: n.isNotNull())
    shown = F.array_join(F.array_sort(F.array_distinct(hits)).cast("array<string>"), ", ")
    out = lambda found, *parts: F.struct(F.concat(*parts).alias("text"), F.lit(found).alias("found"))
    label = F.when(F.contains(F.lower(s), F.lit("or")), "either accepted").otherwise("multiple correct")
    return (
        F.when(s == "", out(False, F.lit(NOT_FOUND)))
        .when((kind == "single") & s.rlike(r"^[1-4]\z"), out(True, F.lit("Correct Option: "), s))
        .when(F.size(pieces) == 0, out(True, F.lit("Answer key (raw): "), s))
        .when(F.size(hits) == 0, out(True, F.lit("Answer key references unknown Option ID: "), F.array_join(pieces, ", "), F.lit(" (raw: "), s, F.lit(")")))
        .when(F.size(hits) == 1, out(True, F.lit("Correct Option: "), shown))
        .otherwise(out(True, F.lit("Correct Options: "), shown, F.lit("  ("), label, F.lit(")")))
    )


def payload(answer: Column) -> Column:
    return F.to_json(F.struct(show(answer).alias("text"), answer["kind"].alias("kind"), answer["raw"].alias("raw")))
