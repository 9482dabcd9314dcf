"""Personal data by bootstrapped contextual extraction.

Seeds are the four base kinds (email, ip, card, phone; see ``base_spans``) and key-like strings. A lexical pattern is
a cue, lower-cased: a word, in quotes or not, with a following : or =, or the one or two words right before a value that
looks like an identifier. A value runs to its delimiter, whatever its length. Wherever a cue stands, it and the value
behind it are an edge of a pattern-instance graph. Spark scores it in ROUNDS rounds: a value's score for a kind is 1 if it is a seed, else the
best score of the trusted cues it follows; a cue's score is the share of its occurrences whose values score. Cues of
ACCEPT or more with MIN_TIMES occurrences and MIN_VALUES different values are trusted, however large the table; in the
end each value behind a trusted cue that looks like an identifier is a span of the cue's kind, unless it overlaps
another span. Trusted cues of up to TRUSTED_BYTES are broadcast. More are never collected: the cues of each text are
joined to them, and each text gets its own.

Spans are code points, end exclusive, ordered by kind (email, ip, card, phone, then others by name) and start.
Defined results: null and empty texts have no spans; repeated rows are read one by one and count as often; a null
doc_id stays null; an empty table gives no rows; other columns are not read. Every scan is linear in the text. The
graph is grouped by (cue, value) with partial sums before any shuffle, and is never collected.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import cut, fresh, slices, texts_of

KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"
ROUNDS, ACCEPT, MIN_TIMES, MIN_VALUES = 3, 0.7, 5, 3
#: Bytes of trusted cues that are broadcast.
TRUSTED_BYTES = 8 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
#: What goes on a word besides letters and digits: combining marks are part of the words of many scripts.
JOINS = frozenset("_-" + "".join(chr(i) for i in range(0x300, 0x20000) if unicodedata.category(chr(i))[0] == "M"))
_ENDS = "\\s\"'<>,;:="
VALUE = re.compile(rf"\x20?[\"']?([^{_ENDS}]{{4,}})")
#: The rest of a value.
REST = re.compile(rf"[^{_ENDS}]+")
SPOT = re.compile("[0-9@]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        if (m := DOMAIN.match(text, at)) and at > done and text[at - 1] in LOCAL:
            start = at - 1
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, in order."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))] if "." in text else []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def key_like(value: str) -> bool:
    """Sixteen or more letters and digits, well mixed."""
    n = sum(c in "0123456789" for c in value)
    return len(value) >= 16 and value.isalnum() and n >= 4 and len(value) - n >= 2


def identifier_like(value: str) -> bool:
    return any(c in "0123456789@" for c in value)


def identifiers(text: str) -> Iterator[tuple[int, int]]:
    """Runs between delimiters that hold a digit or @."""
    done, m = 0, SPOT.search(text)
    while m:
        start = m.start()
        while start > done and not (text[start - 1] in "\"'<>,;:=" or text[start - 1].isspace()):
            start -= 1
        done = REST.match(text, m.start()).end()
        yield start, done
        m = SPOT.search(text, done)


def word_before(text: str, end: int) -> int:
    """Where the run of word characters that ends there begins."""
    while end and (text[end - 1].isalnum() or text[end - 1] in JOINS):
        end -= 1
    return end


def is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def cue_before_sign(text: str, at: int) -> str | None:
    """The word right before a : or =, in quotes or not, from its first letter on."""
    end = at - 1 if at and text[at - 1] == " " else at
    end = end - 1 if end and text[end - 1] in "\"'" else end
    start = word_before(text, end)
    while start < end and not is_letter(text[start]):
        start += 1
    return text[start:end] if start < end else None


def words_before_value(text: str, at: int) -> str | None:
    """The one or two words, each with its blank, right before a value."""
    end = at - 1 if at and text[at - 1] in "\"'(" else at
    out = None
    for _ in range(2):
        if not end or text[end - 1] != " ":
            break
        start = word_before(text, end - 1)
        if start == end - 1 or not is_letter(text[start]):
            break
        out, end = text[start:end] + (out or ""), start
    return out


def cues(text: str) -> Iterator[tuple[str, int, int]]:
    """(cue, start, end of the value) wherever a word, quoted or not, stands before : or =, and then wherever one or two
    words stand right before what looks like an identifier. A word is looked at a few times at most."""
    if ":" in text or "=" in text:
        for m in re.finditer("[:=]", text):
            at = m.start()
            if (v := VALUE.match(text, at + 1)) and (c := cue_before_sign(text, at)):
                yield c.lower() + m[0], v.start(1), v.end(1)
    for start, end in identifiers(text):
        opened = start
        while start < end and text[start] == "(":
            start += 1
        while end > start and text[end - 1] in ".!?)]}":
            end -= 1
        if end - start >= 4 and opened and identifier_like(text[start:end]) and (c := words_before_value(text, opened)):
            yield c.lower(), start, end


class Cover:
    """Spans that don't overlap each other, in order of their starts: whether one overlaps is found by bisection."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.add(a, b)

    def add(self, start: int, end: int) -> None:
        """A span behind all others."""
        self.starts.append(start)
        self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def seeds_of(base: list[tuple[str, int, int]]) -> Callable[[str, int, int], str | None]:
    """Gives the seed kind of a value: the first kind, in their order, that a base span on it has, or a key."""
    covers = [(kind, Cover((a, b) for k, a, b in base if k == kind)) for kind in KINDS if any(k == kind for k, _, _ in base)]

    def seed_of(text: str, start: int, end: int) -> str | None:
        for kind, cover in covers:
            if cover.meets(start, end):
                return kind
        return SECRET if key_like(text[start:end]) else None

    return seed_of


def find_spans(text: str, trusted: dict[str, str]) -> list[tuple[str, int, int]]:
    """Base spans, keys and what trusted cues reveal, in order."""
    out = base_spans(text)
    if "AKIA" in text:
        cover = Cover((a, b) for _, a, b in out)
        out += [(SECRET, m.start(), m.end()) for m in KEY.finditer(text) if not cover.meets(m.start(), m.end())]
    if trusted:
        cover, revealed = Cover((a, b) for _, a, b in out), (Cover(), Cover())
        for cue, start, end in cues(text):
            if (kind := trusted.get(cue)) and identifier_like(text[start:end]) and not any(c.meets(start, end) for c in (cover, *revealed)):
                out.append((kind, start, end))
                revealed[cue[-1] not in ":="].add(start, end)  # both kinds of cue come in the order of the text
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (order.get(s[0], len(KINDS)), s[0], s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def graph(df: DataFrame, text: str = "text") -> DataFrame:
    """(cue, value, seed, n): edges of the pattern-instance graph; value is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found: Counter = Counter()
            for t in texts_of(batch.column(0)):
                seed_of = None
                for cue, start, end in cues(t):
                    seed_of = seed_of or seeds_of(base_spans(t))
                    found[cue, hashlib.blake2b(t[start:end].encode("utf-8", "replace"), digest_size=12).hexdigest(), seed_of(t, start, end)] += 1
            if found:
                rows = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)] + [pa.array(list(found.values()), pa.int64())], ["cue", "value", "seed", "n"])

    return df.select(text).mapInArrow(run, "cue string, value string, seed string, n bigint").groupBy("cue", "value", "seed").agg(F.sum("n").alias("n"))


def trust(edges: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, min_times: int = MIN_TIMES, min_values: int = MIN_VALUES) -> DataFrame:
    """(cue, kind, score) of the trusted cues."""
    edges = cut(edges)
    links = edges.groupBy("cue", "value").agg(F.sum("n").alias("n"))
    totals = links.groupBy("cue").agg(F.sum("n").alias("times"), F.count("*").alias("values"))
    seeds = edges.where("seed IS NOT NULL").groupBy("value", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    scores, cues_now = seeds, None
    for _ in range(rounds):
        evidence = links.join(scores, "value").groupBy("cue", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("good"))
        cues_now = cut(evidence.join(totals, "cue").select("cue", "kind", (F.col("good") / F.col("times")).alias("score"), "times", "values").where(F.col("score") >= accept))
        spread = links.join(cues_now.select("cue", "kind", "score"), "cue").groupBy("value", "kind").agg(F.max("score").alias("score"))
        scores = seeds.unionByName(spread).groupBy("value", "kind").agg(F.max("score").alias("score"))
    kept = cues_now.where((F.col("times") >= min_times) & (F.col("values") >= min_values))
    return kept.groupBy("cue").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))


def with_trusted(df: DataFrame, text: str, most: int = TRUSTED_BYTES) -> tuple[DataFrame, str | None, dict[str, str]]:
    """(df, column, trusted): all trusted cues, or else df with a column of those that each text has (cue and kind in turn)."""
    known = cut(trust(graph(df, text)).select("cue", "kind"))
    if (known.agg(F.sum(F.octet_length("cue") + F.octet_length("kind"))).first()[0] or 0) <= most:
        return df, None, {r.cue: r.kind for r in known.collect()}
    key, own = fresh(df, "_text_key"), fresh(df, "_trusted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found = {(k, c) for k, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))) for c, a, b in cues(t) if identifier_like(t[a:b])}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(2)], ["key", "cue"])

    reveals = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))  # others have nothing behind a cue, and stay where they are
    some = df.where(reveals).withColumn(key, F.sha2(text, 256))
    met = some.select(key, text).mapInArrow(run, "key string, cue string").distinct().join(known, "cue")
    # written, so that both sides of the join are plain shuffles: Spark then splits a text that many rows share
    each = cut(met.groupBy(F.col("key").alias(key)).agg(F.flatten(F.collect_list(F.array("cue", "kind"))).alias(own)))
    out = some.join(each, key, "left").drop(key)
    return out.unionByName(df.where(~reveals).withColumn(own, F.lit(None).cast("array<string>"))), own, {}


def pairs_of(flat: list[str] | None) -> dict[str, str]:
    return dict(zip(flat[::2], flat[1::2])) if flat is not None else {}


def extract(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = TRUSTED_BYTES) -> DataFrame:
    named = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows, own, trusted = with_trusted(named, "text", most)
    shared = df.sparkSession.sparkContext.broadcast(trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = shared.value
        for batch in slices(batches, 1024):
            texts = texts_of(batch.column(1))
            trusted = map(pairs_of, batch.column(2).to_pylist()) if own else repeat(everywhere)
            base = [base_spans(t) for t in texts]
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([joined(find_spans(t, x)) for t, x in zip(texts, trusted)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = df.schema[doc_id].dataType.simpleString()
    return rows.select("doc_id", "text", *[own] * bool(own)).mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact_text(text: str, trusted: dict[str, str]) -> str:
    """The text with [KIND] for each span; of overlapping ones the first and longest names them all."""
    out, done = [], 0
    for kind, start, end in sorted(find_spans(text, trusted), key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(df: DataFrame, trusted: dict[str, str], text: str = "text", own: str | None = None) -> Column:
    """own: a column with each text's own trusted cues, instead of all."""
    shared = df.sparkSession.sparkContext.broadcast(trusted)
    if own:

        @F.pandas_udf("string")
        def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for texts, flats in batches:
                yield pd.Series([None if t is None else redact_text(t, pairs_of(x)) for t, x in zip(texts, flats)], dtype=object)

        return each(F.col(text), F.col(own))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else redact_text(t, shared.value))

    return run(F.col(text))


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars", most: int = TRUSTED_BYTES) -> DataFrame:
    """df with its texts redacted; a column n_chars is counted anew."""
    rows, own, trusted = with_trusted(df, text, most)
    out = rows.withColumn(text, redacted(rows, trusted, text, own)).drop(*[own] * bool(own))
    return out.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType)) if n_chars in df.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every document."""
    from docforge.llm.common import table

    return extract(table(spark, sf_dir, "documents"))
