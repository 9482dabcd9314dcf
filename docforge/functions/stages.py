"""Five stages by which a manuscript becomes a finished book: paragraphs, lines and sentences of talk about making it go.

Patterns are looked for anywhere, whatever their case, in text whose runs of blanks are one space. Names of people and titles
of single books are left out; pass them as ``custom``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docforge.functions.rules import factored

BREAK = r"[\n\r\x0B\f\x1C\x1D\x1E\x85\x{2028}\x{2029}](?:(?<=\r)\n)?"
NO_BREAK, BLANKS = "\u00a0", " \t\n\x0b\f\r\u00a0"
#: Blanks that aren't one space already, and breaks that are no blanks.
UNEVEN = r"[ \t\n\x0B\f\r\x{A0}](?:[ \t\n\x0B\f\r\x{A0}]+|(?<! ))"
#: What a pattern holds that looks beyond what it matches, words' edges aside.
EDGED = re.compile(r"\^|\$|\(\?|\\[ABGZz]")
ODD_BREAK = r"[\x1C-\x1E\x85\x{2028}\x{2029}]"
STARS = r"\x{2B50}+"
EMOJI = r"[\x{2B50}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]+"


@dataclass(frozen=True)
class Stage:
    """What goes: paragraphs, sentences and lines that hold a pattern; characters that match erased before lines are
    looked at; and, where odd is set, whole paragraphs that are blank or match it."""

    paragraphs: tuple[str, ...]
    sentences: tuple[str, ...]
    lines: tuple[str, ...] = ()
    erased: str | None = None
    odd: str | None = None


# What is said around a manuscript, by stage.
DRAFT = Stage(
    paragraphs=(
        r"Proceed to Disorder\s+\d+", r"Ready for Disorder\s+\d+", r"Ready for next", r"^NEXT$", r"next module", r"continuing seamlessly", r"now continuing",
        r"now we begin", r"now we move into", r"this module includes", r"section completed", r"disorder \d+ completed", r"completed successfully", r"status update",
        r'say "?Proceed', r"would you like", r"if you want", r"once you confirm", r"confirm here", r"I'll generate", r"I'll prepare", r"I'll create", r"I'll deliver",
        r"I'll clearly inform you", r"copy.*paste.*Word", r"save as \.docx", r"save as \.pdf", r"cover page", r"title page", r"branding discussion",
        r"layout/style discussion", r"Word export discussion", r"proposed structure", r"planned structure", r"next section \(preview\)", r"this completes your manual",
        r"auto-link them inside Word", r"formatted in Word", r"page numbers instructions", r"PART \w+ is NOT yet fully complete", r"\[PASTE START", r"\[PASTE END",
        r"Apply your usual styles", r"This module will be practitioner gold", r"Fantastic - we're now stepping into", r"Now we begin Module", r"if you approve",
        r"same premium format", r"practitioner-ready format", r"fully structured, formatted, and sequentially aligned",
    ),
    sentences=(
        r"\bNEXT\b", r"Proceed to Disorder\s+\d+", r"Ready for Disorder\s+\d+", r"Ready for next", r"next module", r"continuing", r"now continuing", r"now we begin",
        r"now we move into", r"this module includes", r"section completed", r"disorder \d+ completed", r"completed successfully", r"status update", r"when ready",
        r'say "?proceed', r"buddy\b", r"would you like", r"if you want", r"just say", r"once you confirm", r"confirm here", r"awesome", r"perfect", r"fantastic",
        r"superb", r"yes buddy", r"I'll generate", r"I'll prepare", r"I'll create", r"I'll deliver", r"I'll clearly inform you", r"return when done",
        r"copy.*paste into Word", r"paste into Word", r"use \[PAGE BREAK\]", r"apply your styles", r"save as \.docx", r"save as \.pdf", r"cover page discussion",
        r"title page discussion", r"branding discussion", r"layout/style discussion", r"word export discussion", r"proposed structure", r"planned structure",
        r"next section preview", r"this completes your manual", r"auto-link them inside Word", r"formatted in Word", r"page numbers instructions",
        r"Part \w+ is not yet fully complete", r"\[PASTE START", r"\[PASTE END", r"Apply your usual styles", r"This module will be practitioner gold",
        r"Fantastic - we're now stepping into", r"Now we begin Module", r"if you approve", r"same premium format", r"practitioner-ready format",
        r"fully structured, formatted, and sequentially aligned",
    ),
    lines=(r"^\[SOURCE PAGE \d+\]$", r"^NEXT$"),
)
TALK = (
    r"let'?s make", r"let'?s now", r"we'?ll make", r"we'?ll build", r"we'?ll create", r"we'?ll design", r"we'?ll generate", r"we'?ll now build", r"we now begin",
    r"we now move", r"we now step", r"we now continue", r"here'?s how", r"this section will", r"this module will", r"this part will", r"this becomes",
    r"this is where", r"this is one of the most", r"\bbuddy\b", r"\bawesome\b", r"\bperfect\b", r"\bfantastic\b", r"great job", r"ready when you are",
    r"say proceed", r"once you confirm", r"if you approve", r"just say the word", r"once you paste", r"copy paste into word", r"paste into word", r"apply styles",
    r"assign heading", r"save as docx", r"export to pdf", r"in word assign heading", r"apply heading style", r"paste this section", r"copy this into word",
    r"word file", r"layout selection", r"title page discussion", r"cover page discussion", r"branding section", r"manual structure planning", r"format disorder",
    r"format section", r"format module", r"proceed to disorder", r"disorder completed", r"completed successfully", r"ready for next", r"next module",
    r"next section preview", r"\[PAGE BREAK\]", r"\[PASTE START\]", r"\[PASTE END\]",
)
ULTRA = Stage(paragraphs=TALK, sentences=TALK, lines=(r"^\[source page ", *TALK), erased=STARS)
MERGED = Stage(
    paragraphs=(
        r"^WHERE TO PLACE IT:?$", r"^Place this section immediately before", r"^Pro Tip: In Word", r"^add it right before", r"^keep it printed", r"^laminate it",
        r"^ready for Word paste", r"^color block design", r"^soft blue headers", r"^neutral gray text blocks", r"^assign heading styles",
        r"^layout\s*[->]+\s*columns", r"^Word formatting instructions",
    ),
    sentences=(
        r"\bpractitioner-ready\b", r"\bpremium format\b", r"\bpolished format\b", r"\bhighly practical\b", r"\bclinic autopilot\b", r"\bevery dietitian must master\b",
        r"\bWHERE TO PLACE IT:?\b", r"\bPlace this section immediately before\b", r"\bPro Tip: In Word\b", r"\badd it right before\b", r"\bkeep it printed\b",
        r"\blaminate it\b", r"\bready for Word paste\b", r"\bcolor block design\b", r"\bsoft blue headers\b", r"\bneutral gray text blocks\b",
        r"\bassign heading styles\b", r"\blayout\s*[->]+\s*columns\b", r"\bWord formatting instructions\b",
    ),
    lines=(r"^\[source page ", r"^\[(?-i:PAGE BREAK|PASTE START|PASTE END)\]$", r"^[\s*]+$"),
    erased=STARS,
    odd=r"^[\s*\x{2B50}]+$",
)
CLEAN = Stage(
    paragraphs=(
        r"^Preamble\s*&\s*Purpose of the Manual$", r"^Who This Manual Is For$", r"^Purpose of this section$", r"^Why this section exists$", r"^This module teaches",
        r"^This manual helps you", r"^place this section before", r"^insert this section", r"^layout suggestion", r"^word formatting", r"^color blocks",
        r"^heading style instructions",
    ),
    sentences=(
        r"\bPreamble\s*&\s*Purpose of the Manual\b", r"\bWho This Manual Is For\b", r"\bPurpose of this section\b", r"\bWhy this section exists\b",
        r"\bThis module teaches\b", r"\bThis manual helps you\b", r"\bpractitioner-ready\b", r"\bpolished format\b", r"\bpremium edition\b", r"\bplatinum edition\b",
        r"\badvanced manual\b", r"\bclinic weapon\b", r"\bSUPER IMPORTANT\b", r"\bultra-fast\b", r"\byou will never forget this\b", r"\byou'?ll master instantly\b",
        r"\blike a pro\b", r"\bplace this section before\b", r"\binsert this section\b", r"\blayout suggestion\b", r"\bword formatting\b", r"\bcolor blocks\b",
        r"\bheading style instructions\b",
    ),
    lines=(r"^\[PAGE BREAK\]$", r"^\[PASTE START\]$", r"^\[PASTE END\]$", r"^[*\s]+$"),
    erased=EMOJI,
)
READY = Stage(
    paragraphs=(
        r"^SECTION A\s*-", r"^SECTION B\s*-", r"^FOUNDATION MODULES", r"^THERAPEUTIC MODULES", r"^PRACTICE MODULES", r"^PROFESSIONAL TOOLKIT", r"^MODULE LISTS",
        r"^INDEX CREATION TEXT",
    ),
    sentences=(
        r"\bshould we add\b", r"\bthis section fits before\b", r"\bplace before glossary\b", r"\bdo you want\b", r"\blet'?s add\b", r"\bfits right before\b",
        r"\byou'?ll never forget\b", r"\bsuper important\b", r"\bclinic weapon\b", r"\badvanced manual\b", r"\bpremium edition\b", r"\binstant mastery\b",
        r"\bultimate system\b",
    ),
    lines=(r"^[\s*#>~`_^\-]+$",),
    erased=STARS,
    odd=r"^[\s*#>~`_^\-]+$",
)
STAGES = (DRAFT, ULTRA, MERGED, CLEAN, READY)


def either(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, UNEVEN, " "))


def finished(text: Column, stage: Stage, custom: tuple[str, ...] = ()) -> Column:
    """A paragraph after a stage: its sentences that stay, a line each; null if all of it goes or it is null. A paragraph of
    which no sentence stays is empty; a blank one stays empty, or goes in a stage that names odd paragraphs.

    A pattern of the paragraph's own table is looked for in its lines and sentences only where they may read unlike the
    paragraph: where characters are erased, a line between may go, or a break is no blank.
    """
    whole = squeezed(text)
    goes = (whole != "") & whole.rlike(factored((*stage.paragraphs, *custom)))
    if stage.odd:
        goes = goes | (whole == "") | F.trim(text).rlike(stage.odd)
    seen = {p for p in (*stage.paragraphs, *custom) if not EDGED.search(p)}
    own = tuple(p for p in stage.lines if p not in seen)
    unlike = "|".join([ODD_BREAK, *[stage.erased] * bool(stage.erased), *(p.removeprefix("^").removesuffix("$") for p in own)])

    def stay(lines_of: tuple[str, ...], sentences_of: tuple[str, ...]) -> Column:
        lines = F.transform(F.split(F.regexp_replace(text, stage.erased, "") if stage.erased else text, BREAK), lambda x: F.btrim(x, F.lit(BLANKS)))
        if lines_of:
            lines = F.filter(lines, lambda x: (x == "") | ~x.rlike(factored(lines_of)))
        even = F.regexp_replace(F.array_join(lines, "\n"), UNEVEN.replace(r"\x{A0}", ""), " ")
        parts = F.transform(F.split(even, "(?= )(?<=[.!?]) "), lambda x: F.when(F.contains(x, F.lit(NO_BREAK)), squeezed(x)).otherwise(F.trim(x)))
        return F.array_join(F.filter(parts, lambda x: (x != "") & ~x.rlike(factored(sentences_of)) if sentences_of else x != ""), "\n")

    every = (*stage.sentences, *custom)
    new = tuple(p for p in every if p not in seen)
    kept = stay(stage.lines, every)
    if len(new) < len(every):
        kept = F.when(text.rlike("(?i)" + unlike), kept).otherwise(stay((), new))
    return F.when(~goes, kept)


def sql_finished(text: str, stage: Stage) -> str:
    """The same in SQL, for texts of one line without characters that a stage erases."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    has = lambda x, ps: f"regexp_matches({x}, {q(either(ps))})"
    one = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    goes = f"({one} <> '' AND {has(one, stage.paragraphs)})"
    if stage.odd:
        goes += f" OR {one} = '' OR regexp_matches(trim({text}), {q(stage.odd)})"
    split = rf"string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    stay = rf"list_filter(list_transform({split}, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT {has('x', stage.sentences)})"
    line = f"CASE WHEN {text} <> '' AND {has(f'trim({text})', stage.lines)} THEN '' ELSE array_to_string({stay}, chr(10)) END" if stage.lines else f"array_to_string({stay}, chr(10))"
    return f"CASE WHEN NOT ({goes}) THEN {line} END"
