"""Text expressions: pure Column functions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are replaced one by one, and those that go.
FOLDED = {"\u00a0": " ", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-"}
GONE = "\ufe0f\u200d\ufffe\ufffd"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]+"
BULLETS = r"[•●◦▪■◆◇▶►▸▹➤➜➔]+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
LABELLED_PHONE = r"(?i)(?:ph\.?\s*(?:no\.?|num\.?|number)?\s*[:;]?\s*|phone\s*[:;]\s*|mobile\s*[:;]\s*|contact\s*[:;]\s*)[+]?\d[\d\s\-]{7,14}"
TEN_DIGITS = r"(?<![0-9])[0-9]{10}(?![0-9])"
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\ufeff"
# Fixed value: where a paragraph of a finished book is cut into fragments.
FRAGMENT = (
    r"\n+|(?<=[.!?])\s+|(?=\bSECTION\s+\d+)|(?=\bDISORDER\s+\d+)|(?=\bMODULE\s+\d+)|(?=\b(?:Preamble|Overview|Purpose|Theme|Sample Menu|Case Study|Clinical Insight"
    r"|Counseling|Dietary Guidelines|Nutritional Goals|Memory Code|Practical Revision Notes|Author's Note|From the Desk|Early Morning|Breakfast|Mid-Morning|Lunch|Snack|Dinner|Bedtime)\b)"
)
HINDI = r"\x{0900}-\x{097F}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: EMAIL, for Spark: tried once a run of characters, at its beginning or behind the last match, not at every character.
EMAIL_SCAN = rf"(?:(?<![A-Za-z0-9._%+\-])|\G){EMAIL.replace(']+@', ']++@')}"
PHONE_SCAN = LABELLED_PHONE.replace("(?i)(?:", "(?i)(?=[pmc])(?:", 1)


def redact(text: Column) -> Column:
    """E-mail addresses, labelled phone numbers and bare ten-digit numbers go."""
    for pattern in (EMAIL_SCAN, PHONE_SCAN, TEN_DIGITS):
        text = F.regexp_replace(text, pattern, "")
    return text


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


#: What a line holds that normalize_line may change: characters it knows (and their neighbours), blanks, digits in a row.
UNEVEN_LINE = r"[\t-\r@\x{A0}\x{2000}-\x{2BFF}\x{FE0F}\x{FFFD}\x{FFFE}\x{1F300}-\x{1FAFF}]|  |^ | $|[0-9][0-9\s\-]{7}"


def normalize_line(line: Column) -> Column:
    """Plain quotes, dashes and spaces, digits for keycaps, no emoji, one kind of bullet, no personal data, single blanks.
    Most lines hold nothing of that, which one look at them says."""
    return F.when(line.rlike(UNEVEN_LINE), _normal(line)).otherwise(line)


def _normal(line: Column) -> Column:
    out = F.translate(line, "".join(FOLDED) + GONE, "".join(FOLDED.values()))
    out = F.regexp_replace(F.regexp_replace(out, r"([1-9])\x{20E3}", "$1."), r"\x{1F51F}", "10.")
    out = F.regexp_replace(F.regexp_replace(out, EMOJI, ""), r"(?=[^\x00-\x7F])" + BULLETS, "-")
    return squeeze(redact(out))


def sql_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def sql_redact(e: str) -> str:
    """RE2 has no look-around: ten digits are matched with their neighbours, twice for neighbours that two share."""
    from docforge.functions.rules import sql_quote

    e = f"regexp_replace({e}, {sql_quote(EMAIL)}, '', 'g')"
    e = f"regexp_replace({e}, {sql_quote(LABELLED_PHONE)}, '', 'g')"
    ten = "'(^|[^0-9])[0-9]{10}($|[^0-9])'"
    return rf"regexp_replace(regexp_replace({e}, {ten}, '\1\2', 'g'), {ten}, '\1\2', 'g')"


def sql_normalize_line(e: str) -> str:
    from docforge.functions.rules import sql_quote

    keys = "".join(FOLDED)
    e = f"translate({e}, {sql_quote(keys + GONE)}, {sql_quote(''.join(FOLDED.values()))})"
    e = rf"regexp_replace(regexp_replace({e}, '([1-9])\x{{20E3}}', '\1.', 'g'), '\x{{1F51F}}', '10.', 'g')"
    e = f"regexp_replace(regexp_replace({e}, {sql_quote(EMOJI)}, '', 'g'), {sql_quote(BULLETS)}, '-', 'g')"
    return sql_strip(rf"regexp_replace({sql_redact(e)}, '[ \t]{{2,}}', ' ', 'g')")


# Where words that were printed together are parted.
FUSIONS = [r"([a-z])([A-Z])", r"([0-9])([A-Za-z])", r"([a-z])([0-9])"]
FUSED = "[a-z][A-Z0-9]|[0-9,][A-Za-z]"


def part_fused(text: Column) -> Column:
    """Blanks where case, digits and letters meet; no word is exempt."""
    for pattern in FUSIONS:
        text = F.regexp_replace(text, pattern, "$1 $2")
    return text


def split_fused(text: Column) -> Column:
    """The same, and blanks behind commas. Texts without such a place are left as they are after one look."""
    return F.when(text.rlike(FUSED), F.regexp_replace(part_fused(text), ",([A-Za-z])", ", $1")).otherwise(text)


def sql_split_fused(e: str) -> str:
    for pattern in FUSIONS:
        e = rf"regexp_replace({e}, '{pattern}', '\1 \2', 'g')"
    return rf"regexp_replace({e}, ',([A-Za-z])', ', \1', 'g')"


def normalize_text(text: Column) -> Column:
    """No soft hyphens or zero-width characters, single blanks, trimmed lines."""
    out = F.regexp_replace(F.translate(text, "\u00a0" + ZERO_WIDTH, " "), r"[ \t]+", " ")
    return F.array_join(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), "\n")


def script_share(text: Column, ranges: str) -> Column:
    """Share of letters that lie in the ranges; null without letters. Marks of the ranges count as letters."""
    every = F.length(F.regexp_replace(text, rf"[^\p{{L}}{ranges}]", ""))
    own = F.length(F.regexp_replace(text, rf"[^{ranges}]", ""))
    return F.when(every > 0, own / every)


def is_mostly(text: Column, ranges: str = HINDI, share: float = 0.30) -> Column:
    return F.coalesce(script_share(text, ranges) > share, F.lit(False))


def strip_script(text: Column, ranges: str = HINDI) -> Column:
    """The text without the lines that are mostly of a script."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_mostly(x, ranges)), "\n")


def paragraph_key(text: Column) -> Column:
    """Lower-case letters and digits; empty for other scripts."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def grams(key: Column, n: int = 4) -> Column:
    """Distinct n-grams; none of shorter strings."""
    return F.when(F.length(key) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - (n - 1)), lambda i: F.substring(key, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def words(text: Column) -> Column:
    s = strip(text)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def tokens_estimate(n_words: Column) -> Column:
    return F.floor(n_words * F.lit(1.33)).cast("int") + 1


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def sql_sentences(e: str) -> str:
    return rf"string_split(regexp_replace({e}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def fragments(text: Column) -> Column:
    """Pieces between lines, behind sentences, and before structure words, which stay with what they head."""
    return F.split(text, FRAGMENT)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def output_name(name: Column, with_key: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.when(with_key, "_with_key").otherwise("_cleaned"), F.lit(".pdf"))


def safe_title(title: Column) -> Column:
    return F.substring(F.regexp_replace(title, r"[^A-Za-z0-9 _-]", ""), 1, 50)
