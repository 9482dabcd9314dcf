"""Rendering rules as expressions: markup, tables, headings, front matter and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docforge.functions import rules
from docforge.functions.text import strip

# Characters of the markup, words in capitals that name nothing, and the forms of facts.
TYPST = r"([\\#*_=\[\]$<>])"
COMMON_CAPITALS = [
    "I", "The", "A", "An", "In", "Of", "And", "Or", "With", "For", "To", "As", "At", "By", "From", "On", "Its", "Be", "Is", "Are", "Was", "Were", "Has", "Have",
    "Had", "This", "That", "These", "Those", "Such", "Each", "Both", "All", "Any", "Some", "No", "Not", "But", "If", "So", "Yet",
]
NUMBER = r"\b\d+(?:[.,]\d+)*\b"
TERM = r"\b(?:[A-Z][a-z]{2,}(?:[- ][A-Z][a-z]{2,})*|[A-Z]{2,})\b"
UNIT = r"(?i)\b(?:mg|g|kg|mcg|ug|iu|mmol|mol|meq|mosm|kcal|cal|ml|dl|l|mg/dl|g/dl|mmhg|mmol/l|meq/l|iu/l|u/l|ng/ml|pg/ml|cm|mm|m|bmi)\b"


def escape_typst(text: Column, legacy_double: bool = False) -> Column:
    """A backslash before each character that markup gives a meaning."""
    return F.regexp_replace(text, TYPST, r"\\\\$1" if legacy_double else r"\\$1")


def cells(row: Column) -> Column:
    """Trimmed cells; empty ones at the edges are not cells."""
    inner = F.regexp_replace(F.trim(row), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def parse_table(content: Column) -> Column:
    """array<array<string>> of a piped table: no separator rows, padded to the widest row."""
    rows = F.transform(F.filter(F.split(content, "\n"), lambda r: F.contains(r, F.lit("|")) & ~r.rlike(r"^[\s|:\-]+$")), cells)
    width = F.aggregate(rows, F.lit(0), lambda w, r: F.greatest(w, F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def table_markup(content: Column) -> Column:
    rows = parse_table(content)
    body = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit("["), escape_typst(c), F.lit("]"))), ", ")), ",\n  ")
    return F.concat(F.lit("#table(columns: "), F.size(rows[0]).cast("string"), F.lit(",\n  "), body, F.lit("\n)"))


def table_rows(content: Column) -> Column:
    """The exporter's rows: cut at " | " if the first row has it, else at |; every empty cell goes."""
    lines = F.filter(F.split(content, "\n"), lambda r: F.contains(r, F.lit("|")))
    wide = F.contains(F.element_at(lines, 1), F.lit(" | "))
    return F.transform(lines, lambda r: F.filter(F.transform(F.when(wide, F.split(r, r" \| ")).otherwise(F.split(r, r"\|")), lambda x: F.trim(x)), lambda c: c != ""))


def item_type(text: Column, size: Column, body: Column) -> Column:
    """heading-1 to heading-3 by size, list-item by form, else body."""
    ratio = F.when(body > 0, size / body).otherwise(1.0)
    return F.when((ratio >= 1.3) | (size >= 14), "heading-1").when((ratio >= 1.1) | (size >= 12), "heading-2").when((ratio >= 1.05) | (size >= 11.5), "heading-3").when(text.rlike(rules.LIST_ITEM), "list-item").otherwise("body")


def heading_confidence(text: Column, size: Column, median: Column, y_share: Column) -> Column:
    """0.95 for explicit chapter words, 0.70 for large text in the upper part of a page; null for what is no heading."""
    return F.when(text.rlike(rules.CHAPTER), 0.95).when((y_share < 0.4) & (size / F.nullif(median, F.lit(0.0)) >= 1.3), 0.70)


def upper_headings(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(rules.H1), F.upper(x)).otherwise(x)), "\n")


def heading_title(text: Column) -> Column:
    """The first CHAPTER, else PART, else SECTION line; else a first line of under 120 characters; else null."""
    found = [F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^({word}[^\n]*)$", 1)), F.lit("")) for word in (r"CHAPTER\s+\d+", r"PART\s+[IVXLCDM\d]+", r"SECTION\s+\d+")]
    first = F.trim(F.split(F.trim(text), "\n")[0])
    return F.coalesce(*found, F.when((F.length(first) < 120) & (first != ""), first))


def chapter_banner(number: Column, title: Column) -> Column:
    bar = "=" * 60
    return F.concat(F.lit(f"\n{bar}\nCHAPTER "), number.cast("string"), F.coalesce(F.concat(F.lit(": "), title), F.lit("")), F.lit(f"\n{bar}\n"))


def front_matter(section: Column, title: Column) -> Column:
    return F.concat_ws("\n", F.upper(F.regexp_replace(section, "_", " ")), F.lit(""), F.concat(F.lit("[Placeholder for "), title, F.lit("]")))


def back_matter(chapters: Column) -> Column:
    return F.concat_ws("\n", F.lit("INDEX"), F.lit(""), F.array_join(chapters, "\n"))


def markdown(tag: Column, text: Column) -> Column:
    return F.when(tag == "H1", F.concat(F.lit("# "), text)).when(tag == "H2", F.concat(F.lit("## "), text)).when(tag == "H3", F.concat(F.lit("### "), text)).when(tag == "LIST", F.concat(F.lit("- "), strip_bullet(text))).otherwise(text)


def strip_bullet(text: Column) -> Column:
    return F.regexp_replace(text, r"^[-*•]\s*", "")


def keeps_facts(old: Column, new: Column) -> Column:
    """Whether each number, unit (whatever its case) and capitalised term of a text occurs in its rewriting, as a substring."""
    found = lambda p: F.regexp_extract_all(old, F.lit(f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})"), F.lit(1))
    terms = F.filter(found(TERM), lambda t: ~t.isin(COMMON_CAPITALS))
    return (F.trim(new) != "") & F.forall(found(NUMBER), lambda x: F.contains(new, x)) & F.forall(found(UNIT), lambda x: F.contains(F.lower(new), F.lower(x))) & F.forall(terms, lambda x: F.contains(new, x))


def keeps_table(old: Column, new: Column) -> Column:
    """Whether all cells of two characters or more, and as many rows, are there."""
    cell_set = lambda t: F.array_distinct(F.filter(F.flatten(table_rows(t)), lambda c: F.length(c) >= 2))
    return (F.size(F.array_except(cell_set(old), cell_set(new))) == 0) & (F.size(table_rows(new)) >= F.size(table_rows(old)))


def preview_kind(line: Column) -> Column:
    """Marker, heading, subheading, kicker or paragraph of a preview line."""
    s = F.trim(line)
    return F.when(s.rlike(r"^=+\s*PAGE"), "marker").when((F.length(s) < 90) & s.rlike(rules.H1), "heading").when((F.length(s) < 90) & s.rlike(rules.H2), "subheading").when((F.length(s) < 80) & (F.upper(s) == s) & s.rlike("[A-Z]"), "kicker").otherwise("paragraph")


# Page marks of a section's text, rules below headings, and headings by their words.
PAGE_MARK, H1_RULE, H2_RULE = r"^=====\s*PAGE\s+\d+\s*=====", r"^={3,}$", r"^-{3,}$"
WORD_HEADING, NUMBERED_HEADING = r"(?i)^(?:CHAPTER\s+\d+|(?:PART|SECTION)\s+[IVXLCDM\d]+)", r"^\d+\.\d+(\.\d+)?\s+\S"


def line_kind(line: Column) -> Column:
    """How a section's line is drawn that no rule below makes a heading: chapters, parts and sections are H1, numbered ones
    as deep as the line has dots. assembly.section_lines looks at the lines around, too."""
    s = F.trim(line)
    dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    return (
        F.when(s.rlike(PAGE_MARK), "skip")
        .when(s.rlike(H1_RULE) | s.rlike(H2_RULE), "fence")
        .when(rules.is_pipe_row(s), "table")
        .when(s == "", "blank")
        .when(s.rlike(WORD_HEADING), "H1")
        .when(s.rlike(NUMBERED_HEADING), F.concat(F.lit("H"), F.least(dots + 1, F.lit(3)).cast("string")))
        .otherwise("body")
    )


def plain_text(items: Column) -> Column:
    """Text of array<struct<item_type, text, rows>>: rows of tables joined by bars, empty cells left out."""
    rows = lambda i: F.array_join(F.transform(i["rows"], lambda r: F.array_join(F.filter(r, lambda c: F.trim(c) != ""), " | ")), "\n")
    return F.array_join(F.transform(items, lambda i: F.when(i["item_type"] == "table", rows(i)).otherwise(i["text"])), "\n")


ITEM = "struct<item_type:string,font_size:double,runs:array<struct<text:string,bold:boolean,italic:boolean>>,rows:array<array<string>>>"


def items_to_json(items: Column) -> Column:
    """Content items as JSON; a table has rows, a line font size and runs."""
    return F.to_json(items)


def items_from_json(text: Column) -> Column:
    """array of items out of JSON: body and 11 points where it doesn't say; an old line with text and no runs is one run."""
    old = "array<struct<item_type:string,font_size:double,text:string,bold:boolean,italic:boolean,runs:array<struct<text:string,bold:boolean,italic:boolean>>,rows:array<array<string>>>>"
    run = lambda t, b, i: F.struct(F.coalesce(t, F.lit("")).alias("text"), F.coalesce(b, F.lit(False)).alias("bold"), F.coalesce(i, F.lit(False)).alias("italic"))
    own = lambda i: F.transform(F.coalesce(i["runs"], F.array().cast("array<struct<text:string,bold:boolean,italic:boolean>>")), lambda r: run(r["text"], r["bold"], r["italic"]))
    runs = lambda i: F.when((F.size(own(i)) == 0) & (F.coalesce(i["text"], F.lit("")) != ""), F.array(run(i["text"], i["bold"], i["italic"]))).otherwise(own(i))
    line = lambda i: F.struct(F.coalesce(i["item_type"], F.lit("body")).alias("item_type"), F.coalesce(i["font_size"], F.lit(11.0)).alias("font_size"), runs(i).alias("runs"), F.lit(None).cast("array<array<string>>").alias("rows"))
    table = lambda i: F.struct(F.lit("table").alias("item_type"), F.lit(None).cast("double").alias("font_size"), F.lit(None).cast("array<struct<text:string,bold:boolean,italic:boolean>>").alias("runs"), i["rows"].alias("rows"))
    return F.transform(F.from_json(text, old), lambda i: F.when(i["item_type"] == "table", table(i)).otherwise(line(i)))
