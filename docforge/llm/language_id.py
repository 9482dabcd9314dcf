"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of its labelled text. A text is parsed greedily against it: each phrase is
the longest match that goes on from the place reached, and a letter without a match is a phrase. The language that
needs the fewest phrases for a letter wins; equal counts go to the first name in order.

Texts are lower-cased and every run of characters that aren't letters becomes one space. They are parsed in windows of
WINDOW letters, so that thousands of windows step through the automaton together in numpy; a window's last phrase ends
with it, in all languages alike.

The automata are fitted on a bounded sample of labelled rows, the documented parameters of ``fit``: of every labelled
language the SAMPLE_DOCS documents with the least hashes of their ids, at most SAMPLE_CHARS characters of each and
LEARN_CHARS in all; only documents with a letter there are counted and drawn from. Counting languages reads all rows.
Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never learned from, nor are rows without language, id or
text. An automaton is a table of states by letters where that is small, else (scripts of thousands of letters) a hash
table of its edges, which are fewer than three a character learned; both step alike.

Result per row: doc_id, held_out, lang_pred, score (1 - phrases of the best / phrases of the second best, 0 to 1) and
covered (share of letters inside matches of two or more). Defined results: a text that is null or has no letters is
``und`` with score 0; so is every text if nothing could be learned. A null doc_id is not held out. Repeated rows are
judged one by one; an empty table gives no rows; other columns are not read. No shuffle in prediction; the model is
bounded text for each language.

``keep_known`` also asks whether the winning language explains a text. Every other window of what was learned of a
language is parsed against the rest, as it is and with its letters shuffled; the limit is the geometric mean of their
phrases a letter (half of the shuffled at least), and nearer to the shuffled the less than LEARN_CHARS was learned. A
text goes if it needs more phrases than the limit allows its letters, and SLACK standard deviations (roots of its
phrases) more, so that a few words are no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm.common import fresh, resident

SAMPLE_DOCS, SAMPLE_CHARS, LEARN_CHARS = 64, 2_000, 24_000
WINDOW = 512
UNKNOWN = "und"
MIN_COVERED = 0.3
#: Cells (4 bytes) of a language's automaton that is a plain table, and of how many languages: 64 MB in all; others are hashed.
DENSE_CELLS, DENSE_LANGUAGES = 1 << 21, 8
#: Standard deviations of a text's number of phrases that it may be over its language's limit.
SLACK = 2.0


def held_out_of(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, learn: int = LEARN_CHARS) -> dict[str, str]:
    """Text to learn from, by language."""
    start = F.substring(F.col(text), 1, chars)
    usable = F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & ~held_out_of(F.col(doc_id)) & start.rlike(r"\p{L}")
    counts = {r[0]: r[1] for r in df.where(usable).groupBy(F.col(lang)).count().collect()}
    if not counts:
        return {}
    order = F.xxhash64(F.col(doc_id), F.lit(11))
    unit = (order.cast("double") + 2.0**63) / 2.0**64
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (4 * docs + 16) / n))])[F.col(lang)]  # four times what is needed, by the hash: the last cut is exact
    some = df.where(usable & (unit < rate)).select(F.col(lang).alias("lang"), order.alias("h"), start.alias("text"))
    ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= docs)
    out: dict[str, str] = {}
    for r in ranked.orderBy("lang", "k").select("lang", "text").collect():
        out[r.lang] = out.get(r.lang, "") + " " + r.text
    return {k: " ".join(letters(v)[:learn].split()) for k, v in out.items() if letters(v).strip()}


def letters(text: str) -> str:
    """Lower case; anything but letters becomes a single space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    kept = np.where(_is_letter()[points], points, 32)
    space = kept == 32
    return kept[~(space & np.concatenate([[False], space[:-1]]))].astype("<u4").tobytes().decode("utf-32-le") if len(kept) else ""


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Dense:
    """next[state, symbol] of an automaton; -1 where there is none."""

    def __init__(self, follow: list[dict[int, int]], symbols: int):
        self.width = symbols
        table = np.full((len(follow), symbols), -1, np.int32)
        for state, edges in enumerate(follow):
            for c, to in edges.items():
                table[state, c] = to
        self.table = table.reshape(-1)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.table[state * self.width + symbol]

    def nbytes(self) -> int:
        return self.table.nbytes


class Hashed:
    """The same with memory by edges: an open hash table of (state, symbol)."""

    def __init__(self, follow: list[dict[int, int]], symbols: int):
        n = sum(map(len, follow))
        self.bits = max(4, (3 * n).bit_length())
        self.mask = (1 << self.bits) - 1
        keys = np.fromiter((s << 21 | c for s, edges in enumerate(follow) for c in edges), np.int64, n)
        to = np.fromiter((t for edges in follow for t in edges.values()), np.int32, n)
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(n)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot the last stays
            placed = self.keys[at] == keys[left]
            self.to[at[placed]] = to[left[placed]]
            at, left = (at[~placed] + 1) & self.mask, left[~placed]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 21 | symbol
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.to[at], -1)
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):
            at[on] = (at[on] + 1) & self.mask
            held = self.keys[at[on]]
            same = held == key[on]
            out[on[same]] = self.to[at[on[same]]]
            on = on[~same & (held >= 0)]
        return out

    def nbytes(self) -> int:
        return self.keys.nbytes + self.to.nbytes


def suffix_automaton(text: str, alphabet: dict[str, int], most: int = DENSE_CELLS) -> Dense | Hashed:
    """State 0 is the start; symbol 0 is any character not learned. Tables of more than ``most`` cells are hashed."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in map(alphabet.__getitem__, text):
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return (Dense if len(follow) * (len(alphabet) + 1) <= most else Hashed)(follow, len(alphabet) + 1)


class Parser:
    """Counts phrases of many texts at a time against every language's automaton."""

    def __init__(self, learned: dict[str, str], window: int = WINDOW):
        self.names = sorted(learned)
        self.window = window
        alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(learned.values()))))}
        self.symbol = np.zeros(0x110000, np.int32)
        for c, i in alphabet.items():
            self.symbol[ord(c)] = i
        share = DENSE_CELLS * DENSE_LANGUAGES // max(DENSE_LANGUAGES, len(learned))
        made = [self._model(learned[n], alphabet, share) for n in self.names]
        self.locals, self.tables = ([m[k] for m in made] for k in range(2))
        self.limits = np.asarray([self._limit(learned[n], alphabet) for n in self.names])

    @staticmethod
    def _model(text: str, alphabet: dict[str, int], most: int = DENSE_CELLS) -> tuple[np.ndarray, Dense | Hashed]:
        """(own symbol of each shared one, automaton): a language's table has its own letters only."""
        own = {c: i + 1 for i, c in enumerate(sorted(set(text)))}
        local = np.zeros(len(alphabet) + 1, np.int32)
        for c, i in own.items():
            local[alphabet[c]] = i
        return local, suffix_automaton(text, own, most)

    def _limit(self, text: str, alphabet: dict[str, int]) -> float:
        """Phrases a letter, between the language's own text and its letters shuffled; none for too little text."""
        size = min(self.window, len(text) // 8)
        parts = [text[at : at + size] for at in range(0, len(text) - size + 1, max(1, size))]
        parts = [x for x in parts if len(set(x)) >= 8]  # not runs of a few letters
        if size < 32 or len(parts) < 4:
            return np.inf
        local, table = self._model("".join(parts[::2]), alphabet)
        codes = local[self.symbol[np.frombuffer("".join(parts[1::2]).encode("utf-32-le"), "<u4")]]
        rates = []
        for some in (codes, np.random.default_rng(0).permutation(codes)):
            cells = np.ascontiguousarray(some.reshape(-1, size).T)
            rates.append(np.median(self.phrases(table, cells, np.full(cells.shape[1], size))[0]) / size)
        own = min(1.0, len(text) / LEARN_CHARS) / 2
        return max(rates[0] ** own * rates[1] ** (1 - own), rates[1] / 2)

    def phrases(self, table: Dense | Hashed, cells: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, letters in matches of two or more) of each window. cells: window x symbol, longest windows first."""
        n = len(sizes)
        state, count, inside = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        run = np.zeros(n, np.int32)
        symbols = np.arange(int(cells.max(initial=0)) + 1, dtype=np.int32)
        root = table.step(np.zeros(len(symbols), np.int32), symbols)
        live = np.searchsorted(-sizes, -np.arange(cells.shape[0]), side="left")  # windows longer than each step
        for step in range(cells.shape[0]):
            m = int(live[step])
            if not m:
                break
            c = cells[step, :m]
            s = state[:m]
            to = table.step(s, c)
            dead = to < 0
            ended = dead & (s > 0)
            again = root[c]  # the phrase ends here and the next begins with this letter
            count[:m] += ended
            inside[:m] += np.where(ended & (run[:m] > 1), run[:m], 0)
            begun = np.where(dead, again, to)
            alone = begun < 0
            count[:m] += alone
            run[:m] = np.where(alone, 0, np.where(dead, 1, run[:m] + 1))
            state[:m] = np.where(alone, 0, begun)
        count += state > 0
        inside += np.where((state > 0) & (run > 1), run, 0)
        return count, inside

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, covered) of each text."""
        return self.judge(texts)[:3]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """predict, and whether the language explains the text."""
        clean = [np.frombuffer(letters(t).strip().encode("utf-32-le"), "<u4") for t in texts]
        starts = [(i, a) for i, x in enumerate(clean) for a in range(0, len(x), self.window)]
        counts = np.zeros((len(self.names), len(texts)), np.int64)
        inside = np.zeros((len(self.names), len(texts)), np.int64)
        total = np.asarray([len(x) for x in clean], np.int64)
        for at in range(0, len(starts), 4096):
            some = starts[at : at + 4096]
            sizes = np.asarray([min(self.window, len(clean[i]) - a) for i, a in some])
            order = np.argsort(-sizes, kind="stable")
            sizes = sizes[order]
            doc = np.asarray([i for i, _ in some])[order]
            cells = np.zeros((len(some), int(sizes[0])), np.int32)
            for row, k in enumerate(order):
                i, a = some[k]
                cells[row, : sizes[row]] = self.symbol[clean[i][a : a + self.window]]
            cells = np.ascontiguousarray(cells.T)
            for k, t in enumerate(self.tables):
                n, m = self.phrases(t, self.locals[k][cells], sizes)
                counts[k] += np.bincount(doc, n, len(texts)).astype(np.int64)
                inside[k] += np.bincount(doc, m, len(texts)).astype(np.int64)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        best = counts.argmin(0)
        ranked = np.sort(counts, axis=0)
        second = ranked[1] if len(self.names) > 1 else total
        score = np.where(second > 0, 1 - ranked[0] / np.maximum(second, 1), 0.0)
        covered = inside[best, np.arange(len(texts))] / np.maximum(total, 1)
        none = total == 0
        explained = ranked[0] <= self.limits[best] * np.maximum(total, 1) + SLACK * np.sqrt(ranked[0])
        return [UNKNOWN if z else self.names[b] for b, z in zip(best, none)], np.where(none, 0.0, np.clip(score, 0, 1)), covered, explained


def parser(learned: tuple[tuple[str, str], ...]) -> Parser:
    return resident(("language", learned), lambda: Parser(dict(learned)))


def predict(df: DataFrame, learned: dict[str, str], text: str = "text") -> Column:
    """struct(lang, score, covered, explained) of a text column of df."""
    model = tuple(sorted(learned.items()))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, covered double, explained boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = parser(shared.value)
        for batch in batches:
            parts = [own.judge([t or "" for t in batch[at : at + 256]]) for at in range(0, len(batch), 256)]
            yield pd.DataFrame({"lang": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]], "covered": [x for p in parts for x in p[2]], "explained": [bool(x) for p in parts for x in p[3]]})

    return run.asNondeterministic()(F.col(text))  # else a filter on its result runs it once more


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    made = df.select(F.col(doc_id).alias("doc_id"), held_out_of(F.col(doc_id)).alias("held_out"), predict(df, fit(df, doc_id, text, lang), text).alias("p"))
    return made.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.covered")


def keep_known(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_covered: float = MIN_COVERED) -> DataFrame:
    """df without documents that have no letters, or whose letters no learned language explains."""
    p = fresh(df, "_p")
    marked = df.withColumn(p, predict(df, fit(df, doc_id, text, lang), text))
    return marked.where((F.col(f"{p}.lang") != UNKNOWN) & (F.col(f"{p}.covered") >= min_covered) & F.col(f"{p}.explained")).drop(p)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document."""
    from docforge.llm.common import table

    return identify(table(spark, sf_dir, "documents"))
