"""Rules are data: pattern tables and the compiler that turns a table into a few alternations.

A line is scanned once per table and not once per rule. Patterns keep to what both Java's and RE2's syntax read alike.
What Spark scans is made quick without changing what matches: literal terms are looked for as strings, and patterns that
begin at a word's edge share that edge and a look at the next letter, so that most places of a line fail at once.
Names of people, brands and titles of single books are not part of the tables; pass such terms as ``custom``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of lines that are chat and not content.
STARTS = [
    r"Sure[,!]?\s+here", r"Great question[!.]?", r"Good question[!.]?", r"Absolutely[,!]?\s+", r"Of course[!.]?", r"Certainly[!.]?",
    r"Here is\s+", r"Here's\s+.*content", r"Here's\s+.*chapter", r"Here's\s+.*section", r"Here's\s+.*module", r"Here's\s+.*table", r"Here's\s+.*the next",
    r"Let me now", r"Let me (explain|start|begin|continue|present|summarize|write|provide)", r"Let's (now|begin|start|dive|explore|look)",
    r"Below is", r"Awesome", r"Which options do you want", r"Think of this section as", r"I will now", r"I'll now",
    r"I'll (begin|start|cover|explain|present|continue|write|move)", r"I've (now|already|just|covered|completed|finished)",
    r"As (I|we) (mentioned|discussed|said|noted|explained|covered)", r"As promised", r"Now I'll", r"Now,? let's", r"So basically",
    r"So, (basically|let me|let's|here|we)", r"You (can|should|may|might|will) (see|note|notice|find|observe)", r"We've covered",
    r"We (have now|will now|can now|should|need to)", r"This is the (next|final|last|first).*section", r"Moving (on|forward|ahead|to the next)",
    r"In this (section|chapter|module|part|unit|topic)", r"Would you like me to", r"Before I generate", r"Just confirm", r"Once you reply",
    r"Perfect", r"Excellent", r"Outstanding", r"Done", r"Your wish", r"As your wish", r"If you want, I can", r"Shall I", r"No worries", r"Buddy",
    r"GPT", r"ChatGPT", r"Visible:\s*\d+%", r"If yes, I'll proceed", r"Before I start writing, please confirm", r"Both are professional",
    r"Indexed headers", r"Color-accented boxes", r"Which one should I lock in", r"So the next step:", r"Would you like a dedication page", r"Shall we begin",
    r"Next Module:\s*\d+", r"Here'?s how I'?ll structure", r"The flow will be", r"I'?ll organize this as", r"Here'?s the (structure|outline|format|layout)",
    r"The format will be", r"Which layout do you prefer", r"Option [A-Z] vs Option [A-Z]", r"Here are two approaches", r"Do you want columns or",
    r"Font suggestion:", r"Which style do you prefer", r"Layout (option|choice|preference)", r"This is coming along great", r"Almost done with this section",
    r"Just one more part", r"That wraps up", r"On to the next", r"Final polishing", r"Ready to export", r"This completes the", r"We'?re all set",
    r"That'?s everything for", r"Coming up next", r"Generating Word file", r"Creating PDF", r"Compiling document", r"Formatting complete",
    r"File ready for download", r"Document generated", r"Export complete", r"Here'?s your (file|document|PDF|Word)", r"The (file|document|PDF) is ready", r"Download ready",
    r"I kept it succinct", r"I chose a comprehensive", r"Now, I'll start compiling the Word version", r"therapy alignment - making nutrition science instantly usable",
]

# Whole lines that are chat or page furniture.
WHOLE = [
    r"\[SOURCE PAGE \d+\]", r"=====\s*PAGE\s+\d+\s*=====", r"Sure[!.]?", r"Absolutely[!.]?", r"Yess+\s*!*", r"yes+\s*!*", r"<<?ImageDisplayed>>?",
    r"Page \d+ of \d+", r"Sound good, buddy\??", r"It will include:", r"It'll include:", r"Which one should I go with\??", r"Should it be:", r"or simply",
    r"Next Module Preview", r"Final Tagline", r"A BIG YESS?\s*!*", r"Go ahead[!.]*", r"Continue[!.]*", r"Do it[!.]*", r"Proceed[!.]*", r"Sounds good[!.]*",
    r"That'?s? great[!.]*", r"Love it[!.]*", r"Spot on[!.]*", r"Let'?s do it[!.]*", r"That works[!.]*", r"Looks good[!.]*", r"I like (this|that|it)[!.]*",
    r"You got it[!.]*", r"Exactly[!.]*", r"Right[!.]*", r"OK[!.]*", r"Okay[!.]*", r"Fine[!.]*", r"Go for it[!.]*", r"Make it happen[!.]*",
    r"That'?s? perfect[!.]*", r"Nice[!.]*", r"Cool[!.]*", r"Got it[!.]*", r"Understood[!.]*", r"My approach:?", r"Structure overview:?", r"Next up:?", r"Up next:?",
    r"Elegant section dividers", r"The 'Summary & Quick Recall Sheet' at the end", r"Word\):", r"or shorter like:", r"Liver & Renal Sections", r"Summary \+ Quick-Recall Sheet",
    r"Now, everything is ready for final Word formatting\.?", r"everyday dietitians\.", r"complete on its own\??", r"and practitioner-friendly nutrition modules ever written!?",
    r"Integration", r"and structure intact\.", r"digital release\.", r'"Knowledge becomes power only when applied with purpose\."', r'"Case\s+\d+\s*-.*"\??', r'cucumber slices"\)\.',
]

# Strings that mark a line anywhere in it, in lower case.
CONTAINS = [
    "emoji", "ui fragments", "conversational confirmations", "chat interface", "output limit", "strict preservation extraction",
    "source preservation check", "continuity note", "or simply", "which one should i go with", "your wish", "next module preview",
    "everything is now locked in", "so the next step", "would you like a dedication page", "before i hit finalize", "before i start the compilation pass",
    "you'll receive a version", "shall we begin", "we're now entering", "once you confirm", "before i generate the word file",
    "do you prefer the document layout", "here's the plan for the next output", "would you like this section titled", "everything is ready for final word formatting",
    "copy it directly into word", "color-accented boxes", "indexed headers", "here's what happens next", "dedication page", "i'll merge all confirmed content",
    "final professional sign-off", "reader message", "table of contents", "full sections", "appendices", "acknowledgments",
    "here's how the final ending block", "i'll generate both .docx and .pdf", "this chapter is where clinical accuracy meets patient practicality",
    "benchmark for practical clinical nutrition handbooks", "would you like me to create that file version", "i'll now build this into the full file structure",
    "just confirm these 3 details", "sound good, buddy", "if yes, i'll proceed with the full formatted", "before i start writing, please confirm one small thing",
    "now i'll start building it step-by-step", "hard copy set", "signature manual", "same professional-educational, clinic-ready format",
    "this title gives it a clinical touch", "the first one emphasizes scientific depth", "the second one looks cleaner for clinic use",
    "upcoming cardio-endocrine disorders module", "most premium and practitioner-friendly nutrition modules ever written", "ready-to-print, ready-to-publish version",
    "just confirm one tiny detail for the footer line", "the first looks more professional for publication", "it's complete, polished, and publication-ready",
    "final ending block + preview", "professionally formatted word layout", "professional, motivating, and reader-engaging",
    "this upcoming module explores the interlinked pathways", "summary & quick recall sheet", "endocrine health, connecting:",
    "it's the most essential and applied module", "dietitian and nutritionist - the diabetes mellitus", "you'll learn not only how to plan diets",
    "the skill that sets top clinical dietitians apart",
]

# Chat anywhere in a line.
SEARCH = [
    r"\bwhich do you prefer\b", r"\byes please[!.]?\b", r"\bspot on[!.]?\b", r"\bformat plan\b", r"\bplacement order\b", r"\blayout selection option\b",
    r"\bhere'?s (how|what|the plan|the structure|the outline|the format|the layout|your|my|our)\b",
    r"\bi'?ll (now )?(start|begin|create|generate|build|write|format|compile|structure|organize|prepare|draft|design)\b",
    r"\b(ready to|shall we|want me to|should i|do you want me to)\b", r"^\s*(great|perfect|excellent|awesome|wonderful|amazing|fantastic)[!.]?\s*(choice|question|idea|point)?\s*[!.]?\s*$",
    r"\b(buddy|friend)\s*,?\s*(here|this|we|let|i)\b", r"\bi'?ve (now )?(completed|finished|created|generated|built|compiled|formatted|structured|drafted)\b",
    r"\bthis (section|chapter|module|part|unit) (is|was) (now|finally|officially)\b", r"\blet me know (if|when|what|how|whether)\b",
    r"\bwhat do you think\??\s*$", r"\bhow does (this|that) (look|sound)\??\s*$", r"\bshall i (proceed|continue|go ahead|move on|start)\b",
    r"\bonce you (confirm|approve|reply|respond)\b", r"\bjust (confirm|tell me|let me know)\b", r"\bbefore i (proceed|continue|start|begin|generate|create)\b",
    r"\bready for (the next|your|final|publishing|export)\b", r"\bon to (the next|module|section|chapter|part)\b",
    r"\bthat (wraps|covers|concludes|completes|finishes) (up )?(this|the|our)\b",
    r"\bi read the manual\b", r"\bfrom my end i want\b", r"\bas of now i work\b", r"\bsoon gonna leave\b", r"\bin that mention what is for what\b",
    r"\bthat'?s exactly the mindset\b", r"\byou'?re thinking like a\b", r"\blet'?s design this upgrade\b", r"\bgreat choice[!.]?\s*starting with\b",
    r"\bnext,\s*would you like me to create\b", r"\bwould you like me to create section\b", r"\bthis next section will be your secret\b",
    r"\bif you want,?\s*i'?ll now make you\b", r"\byess please[!.]?\b", r"\b-\s*let'?s roll[!.]?\b", r"\b-\s*great choice[!.]?\b", r"\bit'?ll make you unbeatable\b",
    r"\byour clients will never need a second opinion\b", r"\bonce we create this,? you'?ll have\b", r"\bword\s*\+\s*pdf version\b",
    r"\bconfirm these\s*\d*\s*final details\b", r"\bplanned structure inside the file\b", r"\bfront page setup\b.*edition\b", r"\bthis will be your professional toolbook\b",
]

# Single words that are a whole answer, and forms of lines.
EXACT = ["yes", "yess", "perfect", "excellent", "done"]
PIPE_ROW = r"^\s*\|.+\|.+\|\s*$"
LONE_NUMBER = r"^\s*\d{1,2}\.\s*$"
CASE_HEADER = r'(?i)^"Case\s+\d+\s*-.*"\??\s*$'
LIST_ITEM = r"^\s*(?:[-–—•●▪▫‣·]\s+|[a-zA-Z0-9]{1,3}[.)]\s+)"
HEADINGS = [r"(?i)^\s*(?:SECTION|CHAPTER)\s+\d+[:\-\s]", r"^\s*\d+(\.\d+)+\s+.+$", r"^\s*[A-Z][A-Z0-9 ,&/\-()]{8,}$"]
ALL_CAPS = r"^[A-Z][A-Z0-9 ,&/()\-]{5,79}$"
TABLE_HEADERS = [r"condition\s*/\s*key nutrition focus\s*/\s*supportive nutrients", r"foods to include\s*/\s*foods to avoid\s*/\s*clinical tips"]
SPEAKER = r"(?i)^\s*(?:USER|GPT|ChatGPT|Assistant|You|Human|AI|System)\s*[:\-]\s*"
OPENER = r"(?i)^\s*(?:(?:Sure|Absolutely|Great|Perfect|Excellent|Of course|Certainly|Awesome)[,!.]?\s|Here'?s\s|Let me\s|Let's\s|I'll\s|I will\s|I've\s|Would you\s|Shall I\s|No worries|Now let'?s\s|Now I'll\s|Moving on\s|Moving forward\s|Below is\s|As promised|As I mentioned|As we discussed)"
H1 = r"(?i)^\s*(?:chapter\s+\d+|module\s+\d+|part\s+[IVXLCDM\d]+|unit\s+\d+|section\s+\d+|appendix\s+[A-Z\d])"
H2 = r"^\s*\d{1,2}[.)]\s+[A-Z][a-zA-Z]"
H3 = r"^\s*(?:\d{1,2}\.\d{1,2}\.?\s+[A-Z]|[a-z]\)\s+[A-Z])"
FENCE = r"^\s*```"
CHAPTER = r"(?i)^\s*(?:(?:CHAPTER|SECTION|MODULE|UNIT)\s+\d+|PART\s+(?:[IVXLCDM]+|\d+)\b)"
APPENDIX = r"(?im)^(?:APPENDIX\s*[A-Z]?[.:]?\s*.*|(?:BIBLIOGRAPHY|REFERENCES|INDEX|GLOSSARY|NOTES)[.:]?\s*)$"
# Chat in finished books, by the three generations of the book cleaner. The first looks at the beginning of a
# line, the others anywhere in a fragment; the third also drops whole fragments, and sentences of a book's first part.
BOOK_STARTS = [
    r"If you want", r"Would you like", r"I'll now", r"I will now", r"Let's build", r"Once you reply", r"Next module", r"Superb", r"I'll generate", r"I can create",
    r"I can prepare", r"Confirm these", r"Just confirm", r"Do you want", r"Should I include",
]
BOOK_SEARCH = [
    r"\bIf you want,? I'll\b", r"\bWould you like me to\b", r"\bWould you like this\b", r"\bI'll now make\b", r"\bI'll now draft\b", r"\bI'll prepare\b",
    r"\bI'll generate\b", r"\bI'll create the Word file\b", r"\bLet's build\b", r"\bOnce you reply\b", r"\bNext module(?: options| choices)?\b",
    r"\bNext up, would you like\b", r"\bSuperb\b", r"\bAwesome - I'll take it from here\b", r"\bI can create\b", r"\bI can prepare\b", r"\bConfirm these\b",
    r"\bJust confirm\b", r"\bDo you want to include\b", r"\bShould I include\b", r"\bBefore I create the Word file\b", r"\bBefore I finalize\b",
    r"\bBefore we proceed\b", r"\bReady for the next\b", r"\bStart Disorder\s+\d+\b", r"\bSay:?\s*Start Disorder\s+\d+\b", r"\bHere's what I'll do\b", r"\bNext Step\b",
]
BOOK_SEARCH_MORE = [
    r"\byess please!?\b", r"\bbuddy!?\b", r"\bA BIG YESS!?\b", r"\bWould you like\b", r"\bIf you want\b", r"\bI'll now\b", r"\bI will now\b", r"\bI'll prepare\b",
    r"\bI'll generate\b", r"\bI'll create\b.*Word file", r"\bLet's build\b", r"\bOnce you reply\b", r"\bOnce you pick\b", r"\bWhich do you prefer\b",
    r"\bHere'?s what we'll do step-by-step\b", r"\bconfirm this structure before I create\b", r"\bIf this final structure is confirmed\b", r"\bThat seals it beautifully\b",
    r"\bSubstitution Charts next\?", r"\bHow to Use These Templates\b", r"\bfull examples\) next\?", r"\bFast Choice Builder\) next\?", r"\bTables next\?",
    r"\bCase Study .* next\?", r"\bReady for the next\b", r"\bStart Disorder\b", r"\bSure buddy\b", r"\bProceed to Disorder\s+\d+\b", r"\bJust say\s+[\"']?Proceed[\"']?\b",
    r"\bSay\s+[\"']?Proceed[\"']?\s+when ready\b", r"\bContinuing seamlessly\b", r"\bReady when you are\b", r"\bWe now continue\b", r"\bWe now move into\b",
    r"\bThis module includes\b", r"\bsame premium quality\b", r"\bWord export feature\b", r"\bfinalize this\b", r"\bfull manual\b.*Word", r"\bbuild the full Word version\b",
    r"\bit'?ll look like\b", r"\bonce i create\b", r"\bonce we create\b", r"\bi'?ll immediately generate\b", r"\bthis section will appear\b",
    r"\bbelow is the continuation\b", r"\bfinalized structure\b", r"\bplanned structure inside the file\b", r"\bfinal structure\b", r"\bi read the manual\b",
    r"\bfrom my end i want\b", r"\byes and finally\b", r"\bthat'?s exactly the mindset\b", r"\blet'?s design this upgrade\b", r"\bthis will be your professional toolbook\b",
    r"\bpersonal clinic-ready\b", r"\bso your Word file\b", r"\bfor title i like\b", r"\bwhat clinic name\b", r"\bword file\b", r"\bgenerate the word\b", r"\bexport\b",
    r"\bcompile\b", r"\blayout selection\b", r"\bformatting choice\b", r"\btitle page\b", r"\bfront page\b", r"\bcover page\b", r"\bemail placeholder\b",
    r"\bphone placeholder\b", r"\bclinic branding\b", r"\btagline\b", r"\blayout preference\b", r"\bsection\s+\d+\s+will contain\b", r"\blayout selection option\b",
    r"\bhere'?s the plan\b", r"\bhere'?s the start of your next chapter draft\b", r"\bthis is the section that makes your counseling lightning-fast\b",
    r"\bthis section will make you\b", r"\bclinical nutrition matrix\b.*one-glance reference\b", r"\beducational highlight layout\b", r"\bprofessional minimal\b",
    r"\blayout choice\b", r"\bclinic name\b", r"\bprofessional name/title\b", r"\bformat plan\b", r"\bplacement order\b", r"\bYes gpt we can proceed\b",
    r"\bfor my satisfaction\b", r"\bYou're absolutely right to pause and cross-check\b", r"\bLet me give you a clear, calm, one-screen confirmation\b",
    r"\bSO, TO YOUR QUESTION\b", r"\bANSWER: YES - PLEASE SEND IT\b", r"\bJust list what each tab roughly contains\b", r"\bOnce you send that\b",
    r"\bWhenever you're ready- Send the tab list\b", r"\bI'm aligned with you\b", r"\bChalo gpt\b", r"\bOkay i understand it now\b",
    r"\bExactly - you've understood it 100% correctly\b", r"\bYou don't need to remember\b", r"\bI'll mentally index everything\b", r"\bFuture content will auto-align\b",
    r"\bCompilation becomes clean Word file generation becomes\b", r"\bDisorder\s+\d+\s+COMPLETE\b", r"\bNEXT\b",
]
BOOK_EXACT = ["page?", "3.", "next"]
BOOK_FIRST_PART = [
    r"\badd another section\b", r"\bwe can structure\b", r"\blet'?s design\b", r"\bonce we finalize\b", r"\bfollowing your design\b", r"\bi will generate\b",
    r"\bi will create\b", r"\bi will prepare\b", r"\bbefore i generate\b", r"\bwould you like\b", r"\bonce you confirm\b", r"\blayout option\b", r"\bformat choice\b",
    r"\bcover page\b", r"\bfront page\b", r"\btitle page\b", r"\bemail placeholder\b", r"\bphone placeholder\b", r"\bclinic branding\b", r"\bemail\s*:\s*\S+@\S+",
    r"\bph\.?no\s*[:;]\s*\+?\d+", r"\bphone\s*[:;]\s*\+?\d+", r"\bclinical nutrition practice accelerator\b", r"\bmanual structure\b", r"\bplanned structure\b",
    r"\bsection\s+\w+\s+will contain\b", r"\bi read the manual\b", r"\bfrom my end\b", r"\blet'?s design this upgrade\b",
]
APPENDIX_HEADS = ["GLOSSARY", "HOUSEHOLD MEASURES", "CONVERSION CHART", "KCAL EQUIVALENCE", "REFERENCE INDEX"]

# Exam papers and keys.
SECTION_HINTS = ["PART -", "PART-", "SECTION ID", "SECTION NUMBER", "GROUP NUMBER", "SUB-SECTION"]
COVER_HINTS = ["QUESTION PAPER NAME", "TOTAL MARKS", "DURATION"]
EXAM_NOISE = [
    "Question Type", "Option Shuffling", "Display Question Number", "Is Question Mandatory", "Calculator", "Response Time", "Think Time",
    "Minimum Instruction Time", "Single Line", "Question Option", "Option Orientation", "Allowed Progression", "Number of Replay", "Play On Load",
    "Control Enable", "Time interval to replay", "Allow Volume Control", "Correct Marks", "Wrong Marks", "Notations :", "Options shown in green", "Options shown in red",
]
PAGE_CHROME = r"(?i)^(file:///|https?://|\d{1,2}/\d{1,2}/\d{2,4}[,\s]|PREVIEW\s+QUESTION\s+BANK|Module\s+Name\s*:|Exam\s+Date\s*:|Page\s+\d+\s*(of\s*\d+)?$)"
PRINTED_CHROME = r"(?i)^(\s*\d+\s*\)\s*$|Topic\s*[‐\-:]\s*\S.*$|CSIR\s+[A-Z\s]+SHIFT.*$|Page\s+\d+\s*(of\s*\d+)?$)"
KEY_NOISE = ["NATIONAL TESTING AGENCY", "Question ID", "Correct Option No.", "CORRECT ANSWER", "QUESTION ID", "Exam Date", "Exam Shift", "FINAL ANSWER KEY", "CSIR-UGC", "Page:", "of 6", "of 5", "of 4"]


def either(patterns: list[str], ignore_case: bool = True) -> str:
    """One alternation for a table."""
    return ("(?i)" if ignore_case else "") + "(?:" + "|".join(patterns) + ")"


def starts_pattern() -> str:
    return r"(?i)^\s*(?:" + "|".join(STARTS) + ")"


def whole_pattern() -> str:
    return r"(?i)^\s*(?:" + "|".join(WHOLE) + r")\s*$"


def contains_pattern(terms: list[str]) -> str:
    """Literal terms; every character that a pattern gives a meaning is escaped."""
    return "(?:" + "|".join("".join(f"\\{c}" if c in r".+*?()[]{}|^$\/" else c for c in t) for t in terms) + ")"


def search_pattern(patterns: list[str]) -> str:
    """either(), for Spark: patterns that begin at a word's edge share it and a look at the letters they can begin with."""
    edged = [p.removeprefix(r"\b") for p in patterns if p.startswith(r"\b")]
    firsts = {a[0] for p in edged for a in (p[1 : p.index(")")].split("|") if p.startswith("(") else [p])}
    others = [p for p in patterns if not p.startswith(r"\b")]
    return "(?i)(?:" + "|".join([rf"\b(?=[{''.join(sorted(firsts, reverse=True))}])(?:{'|'.join(edged)})"] * bool(edged) + others) + ")"


#: A part of a pattern that stands alone: a class, a character or an escape of one, with what repeats it.
PART = re.compile(r"(?:\\x\{[0-9A-Fa-f]+\}|\\[^A-Za-z0-9]|\\[bBdDsSwW]|\[(?:[^\[\]\\]|\\.)*\]|[^()|\\\[])(?:(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?)?")


def parts_of(pattern: str) -> tuple[list[str], str]:
    """(parts up to the first that doesn't stand alone, the rest) of a pattern that is looked for whatever its case."""
    parts, left = [], pattern
    while found := PART.match(left):
        parts.append(found[0].lower() if found[0].isascii() and found[0][0] not in "\\[" else found[0])
        left = left[found.end() :]
    bare, inner = re.sub(r"\\.|\[[^\]]*\]", "", left), None
    while bare != inner:
        bare, inner = re.sub(r"\([^()]*\)", "", bare), bare
    return ([], f"(?:{pattern})") if "|" in bare else (parts, left)


def joined(rows: list[tuple[list[str], str]]) -> str:
    """One pattern for all: what they begin with alike is written once. One that ends makes longer ones needless."""
    if any(not parts and not rest for parts, rest in rows):
        return ""
    heads: dict[str, list[tuple[list[str], str]]] = {}
    for parts, rest in rows:
        if parts:
            heads.setdefault(parts[0], []).append((parts[1:], rest))
    found = [*(head + joined(tails) for head, tails in heads.items()), *(rest for parts, rest in rows if not parts)]
    return found[0] if len(found) == 1 else "(?:" + "|".join(found) + ")"


def factored(patterns: list[str] | tuple[str, ...]) -> str:
    """either(), for Spark, where only whether one is found counts: patterns share their beginnings, so that a place fails at
    one look for each different letter, and those of a kind (at a line's beginning, at a word's edge, anywhere) share a look
    at the two letters they can begin with."""
    found = []
    for head in ("^", r"\b", ""):
        rows = [parts_of(p.removeprefix(head)) for p in patterns if (p.startswith(head) if head else not p.startswith(("^", r"\b")))]
        look = ""
        for k in range(2):
            letters = sorted({"".join(parts[k : k + 1]) for parts, _ in rows})
            if not rows or not all(re.fullmatch(r"[a-z0-9' ]|\\[\[/]", x) for x in letters):
                break
            look += f"[{''.join(letters)}]"
        look = look and f"(?={look})"
        found += [head + look + joined(rows)] * bool(rows)
    return "(?i)(?:" + "|".join(found) + ")"


def holds_any(text: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the terms."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def rule_of(line: Column, custom: list[str] | None = None, low: Column | None = None) -> Column:
    """Name of the first rule that drops a line; null for lines that stay. A blank line stays. low: the trimmed line in
    lower case, where it is a column already (terms are looked for in it one by one)."""
    low = F.lower(F.trim(line)) if low is None else low
    out = F.when(F.trim(line) == "", None)
    for name, test in (
        ("start", line.rlike(starts_pattern())),
        ("whole", line.rlike(whole_pattern())),
        ("contains", holds_any(low, [*CONTAINS, *(c.lower() for c in custom or [])])),
        ("exact", low.isin(EXACT)),
        ("pipe_row", line.rlike(PIPE_ROW)),
        ("lone_number", line.rlike(LONE_NUMBER)),
        ("search", line.rlike(search_pattern(SEARCH))),
    ):
        out = out.when(test, name)
    return out


def sql_rule_of(line: str) -> str:
    """The same in SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    m = lambda text, p: f"regexp_matches({text}, {q(p)})"
    low = f"lower(trim({line}))"
    return f"""CASE WHEN trim({line}) = '' THEN NULL WHEN {m(line, starts_pattern())} THEN 'start' WHEN {m(line, whole_pattern())} THEN 'whole'
        WHEN {m(low, contains_pattern(CONTAINS))} THEN 'contains' WHEN {low} IN ({", ".join(map(q, EXACT))}) THEN 'exact' WHEN {m(line, PIPE_ROW)} THEN 'pipe_row'
        WHEN {m(line, LONE_NUMBER)} THEN 'lone_number' WHEN {m(line, either(SEARCH))} THEN 'search' END"""


def sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def should_drop(line: Column, custom: list[str] | None = None) -> Column:
    return rule_of(line, custom).isNotNull()


def drops_element(line: Column, custom: list[str] | None = None) -> Column:
    """should_drop of an array's element: its lower case is made once."""
    return F.exists(F.array(F.lower(F.trim(line))), lambda low: rule_of(line, custom, low).isNotNull())


def is_heading(line: Column) -> Column:
    return (F.length(line) <= 140) & (line.rlike(HEADINGS[0]) | line.rlike(HEADINGS[1]) | line.rlike(HEADINGS[2]))


def is_all_caps_heading(line: Column) -> Column:
    return line.rlike(ALL_CAPS)


def is_table_header(line: Column) -> Column:
    return line.rlike(either(TABLE_HEADERS))


def drops_rich_line(line: Column) -> Column:
    return (F.trim(line) == "") | should_drop(F.trim(line)) | F.trim(line).rlike(CASE_HEADER)


def keeps_block(line: Column, words: int = 4) -> Column:
    """Blocks of enough words, and headings."""
    return (F.size(F.split(F.trim(line), r"\s+")) >= words) | is_heading(line)


def contains_any(text: Column, needles: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(text, n))


def is_exam_metadata(text: Column, question_header: str = r"(?i)Question\s+Number\s*:\s*\d+") -> Column:
    """Empty, a question's header, a lone no-break space, or two needles at least."""
    hits = F.aggregate(F.array(*map(F.lit, EXAM_NOISE)), F.lit(0), lambda n, x: n + F.contains(text, x).cast("int"))
    return (F.coalesce(text, F.lit("")) == "") | text.rlike(question_header) | (hits >= 2) | (F.trim(text) == "\u00a0")


def is_section_header(text: Column) -> Column:
    return contains_any(F.upper(text), SECTION_HINTS)


def is_cover_text(text: Column) -> Column:
    return contains_any(F.upper(text), COVER_HINTS)


def is_key_noise(token: Column) -> Column:
    return contains_any(F.upper(token), [n.upper() for n in KEY_NOISE])


def is_page_chrome(text: Column, printed: bool = False) -> Column:
    """printed: the furniture of papers printed as text."""
    return text.rlike(PRINTED_CHROME if printed else PAGE_CHROME)


def is_pipe_row(line: Column) -> Column:
    """A row for the exporter: a bar anywhere."""
    return F.contains(line, F.lit("|"))


def is_appendix(text: Column) -> Column:
    """A chunk that holds an appendix's heading."""
    return text.rlike(APPENDIX)


def begins_appendix(line: Column, anywhere: bool = False) -> Column:
    """A line from which on a book is appendix: one of the heads in front, or as whole words anywhere in it."""
    heads = "|".join(APPENDIX_HEADS)
    return line.rlike(rf"(?i)\b(?:{heads})\b" if anywhere else rf"(?i)^\s*(?:{heads})")


def tag_of(line: Column) -> Column:
    """Tag of one line outside code: speaker labels and openers are body before any heading rule is asked."""
    s = F.trim(line)
    return F.when(line.rlike(PIPE_ROW), "table").when(s.rlike(SPEAKER) | s.rlike(OPENER), "body").when(s.rlike(H1), "H1").when(s.rlike(H2), "H2").when(s.rlike(H3), "H3").when(s.rlike(LIST_ITEM), "list").otherwise("body")


def sql_tag_of(line: str) -> str:
    m = lambda p: f"regexp_matches(trim({line}), {sql_quote(p)})"
    return f"CASE WHEN regexp_matches({line}, {sql_quote(PIPE_ROW)}) THEN 'table' WHEN {m(SPEAKER)} OR {m(OPENER)} THEN 'body' WHEN {m(H1)} THEN 'H1' WHEN {m(H2)} THEN 'H2' WHEN {m(H3)} THEN 'H3' WHEN {m(LIST_ITEM)} THEN 'list' ELSE 'body' END"


def sql_is_heading(line: str) -> str:
    return f"(length({line}) <= 140 AND (" + " OR ".join(f"regexp_matches({line}, {sql_quote(p)})" for p in HEADINGS) + "))"
