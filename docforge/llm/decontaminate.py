"""Benchmark decontamination by exact weighted shingles over item-sized windows.

Words are lower-cased runs of ASCII letters and digits and of non-ASCII characters, which end at Unicode punctuation and
blanks; in scripts without spaces between words each character is a word. A shingle is WORDS of them and
weighs its characters. For every benchmark item the document is looked at through windows of as many shingles as the
item has: the weight of the item's shingles that the window holds, repeats counted, over the item's weight is its
similarity. THRESHOLD or more is a leak.

Places that hold a shingle of any item are found by a rolling hash over the whole text. Every item-sized window that ends
at such a place, and whose known shingles weigh THRESHOLD of the lightest item of that size, gets PRINTS SimHash
fingerprints of its known shingles: what no item holds counts for no similarity, so a long token between the words of a
leak owns no fingerprint. A shingle votes with the root of its weight, so that window and item lie at the angle
arccos(sqrt(similarity)) whatever single shingles weigh; at THRESHOLD that is 9.5 bits of 64 on average (deviation 2.8),
and all PRINTS are over RADIUS in about one of a million leaks there, and in fewer the more alike they are. Fingerprints
go through a multi-index of the items: one of BLOCKS blocks differs by RADIUS // BLOCKS bits at most, so values near each
block are probed and nothing within RADIUS is missed. Every
item met is then judged exactly, byte by byte, over all its places in the text.

Result per row of documents and item found in it: doc_id, item_id, similarity and start (word) of the best window.
Defined results: null and empty texts and items match nothing; a text with fewer words than a shingle is one shingle,
so a shorter item is only found in a document that says just that; a document shorter than an item is one window;
repeated rows are looked at one by one; items of equal words are all reported; a null item_id stays null; an empty
documents or benchmark table gives no rows. Of a benchmark of more than SLICE_BYTES, slices go over the documents one
after the other; each is let go before the next is collected. Documents are not shuffled (but by drop_leaks with several
slices), and long ones are hashed PIECE bytes at a time.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import cut, fresh, resident

WORDS, THRESHOLD = 5, 0.8
PRINTS, RADIUS, BLOCKS = 6, 15, 4
#: Bytes that the index may take for flips which windows then needn't probe.
INDEX_BYTES = 32 << 20
#: Bytes of items that a worker indexes at a time.
SLICE_BYTES = 16 << 20
#: Hits that are looked at a time, and items whose shingles a worker remembers.
STEP, REMEMBERED = 1024, 1024
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Scripts without spaces between words: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 1 for punctuation and blanks beyond ASCII, 2 for a character that is a word, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[128:0x20000] = [unicodedata.category(chr(i))[0] in "PZ" for i in range(128, 0x20000)]
    ranges = iter(_UNSPACED)
    for first in ranges:
        next(ranges)
        kinds[ord(first) : ord(next(ranges)) + 1] = 2
    return kinds


def apart(text: str) -> str:
    """Blanks for punctuation, and around characters that are words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[points]
    if not kinds.any():
        return text
    points, alone = np.where(kinds == 1, 32, points), kinds == 2
    if alone.any():
        ends = np.cumsum(np.where(alone, 3, 1))
        spread = np.full(int(ends[-1]), 32)
        spread[ends - 1 - alone] = points
        points = spread
    return points.astype("<u4").tobytes().decode("utf-32-le", "replace")


def words_of(text: str) -> list[bytes]:
    text = text.lower()
    if not text.isascii():
        text = apart(text)
    return text.encode("utf-8", "replace").translate(_SPACE).split()


def shingles(words: list[bytes]) -> list[bytes]:
    if len(words) < WORDS:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each shingle the root of its weight (in sixteenths), plus or minus by each bit of PRINTS hashes: one row each."""
    x = hashes[:, None] + np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little").astype(np.int32)
    return (2 * bits - 1) * np.rint(16 * np.sqrt(weights)).astype(np.int32)[:, None]


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """PRINTS unsigned 64-bit integers for each row of summed votes."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of so many bits with at most so many of them set."""
    return np.asarray([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.int64)


_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        for base in (_BASE, inverse):
            steps = np.full(PIECE + 1, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def rolling(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every shingle, by prefix sums over the bytes."""
    if len(words) < WORDS:
        words, span = [b" ".join(words)] if words else [], 1
    else:
        span = WORDS
    power, inverse = _powers()
    out, at, n = [], 0, len(words)
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes)
    while at + span <= n:
        base = ends[at - 1] if at else 0
        to = max(at + span, int(np.searchsorted(ends, base + PIECE, side="right")))
        if ends[to - 1] - base > PIECE:  # words longer than a piece: one shingle by itself
            out.append(np.asarray([xxhash.xxh64_intdigest(b" ".join(words[at : at + span]))], np.uint64))
            at += 1
            continue
        raw = np.frombuffer(b" ".join(words[at:to]), np.uint8)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
        last = ends[at:to] - base - 1  # a word's end, its space left out
        first = last - sizes[at:to] + 1
        a, b = first[: to - at - span + 1], last[span - 1 :]
        out.append((sums[b] - sums[a]) * inverse[a])
        at = to - span + 1
    return np.concatenate(out) * np.uint64(0xFF51AFD7ED558CCD) if out else np.empty(0, np.uint64)


def shingle_sizes(words: list[bytes]) -> np.ndarray:
    """Bytes of every shingle."""
    if not words:
        return np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    span = min(WORDS, len(words))
    return ends[span:] - ends[:-span] - 1


class MultiIndex:
    """Finds all fingerprints within RADIUS, in one of PRINTS, of items of all sizes.

    Some of the RADIUS // BLOCKS flips of a block are filed with the items and windows probe the others: as many are filed
    as INDEX_BYTES hold, so that few items cost a window one look a block, and many items little memory. What is found
    is the same.
    """

    WIDTH = 64 // BLOCKS

    def __init__(self, prints: np.ndarray):
        self.prints, n = prints, len(prints)
        spare = RADIUS // BLOCKS
        self.filed = max(k for k in range(spare + 1) if not k or 4 * n * PRINTS * BLOCKS * len(flips(self.WIDTH, k)) <= INDEX_BYTES)
        near = flips(self.WIDTH, self.filed)
        self.columns = [np.ascontiguousarray(prints[:, k]) for k in range(PRINTS)]
        self.probes = flips(self.WIDTH, spare - self.filed)
        self.lists: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for own in self.columns:
            self.lists.append([])
            for b in range(BLOCKS):
                keys = (self.block(own, b)[:, None] ^ near).reshape(-1)
                order = np.argsort(keys, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << self.WIDTH))]).astype(np.int32)
                self.lists[-1].append((ends, np.repeat(np.arange(n, dtype=np.int32), len(near))[order]))

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(self.WIDTH * b)) & np.uint64((1 << self.WIDTH) - 1)).astype(np.int64)

    def near(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs."""
        n, found = len(self.prints), [np.empty(0, np.int64)]
        step = max(1, 1024 * 137 // (137 + 8 * len(self.probes)))
        for at in range(0, len(windows), step):
            some = windows[at : at + step]
            for k, lists in enumerate(self.lists):
                wanted, own = np.ascontiguousarray(some[:, k]), self.columns[k]
                for b, (ends, items) in enumerate(lists):
                    keys = self.block(wanted, b)[:, None] ^ self.probes
                    first = ends[keys].astype(np.int64)
                    counts = ends[keys + 1] - first
                    each = counts.sum(1)
                    first, counts = first.reshape(-1), counts.reshape(-1)
                    j = items[np.arange(int(each.sum())) + np.repeat(first - np.cumsum(counts) + counts, counts)]
                    good = np.flatnonzero(np.bitwise_count(np.repeat(wanted, each) ^ own[j]) <= RADIUS)
                    w = np.searchsorted(np.cumsum(each), good, side="right")
                    found.append((w + at) * n + j[good])
        return divmod(np.unique(np.concatenate(found)), max(1, n))


class Benchmark:
    """The items, the hashes of their shingles and the multi-index, on every worker. Arrays: some ten bytes a byte of text."""

    def __init__(self, items: list[tuple[object, str]]):
        same: dict[bytes, list[object]] = defaultdict(list)
        for item_id, text in items:
            if words := words_of(text or ""):
                same[b" ".join(words)].append(item_id)
        self.ids, self.texts = list(same.values()), list(same)
        n = len(self.texts)
        self.weight, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.prints, hashed = np.zeros((n, PRINTS), np.uint64), [np.empty(0, np.uint64)]
        for j, text in enumerate(self.texts):
            words = text.split()
            own, weights = rolling(words), shingle_sizes(words)
            self.size[j], self.weight[j] = len(own), weights.sum()
            sums = np.zeros((1, 64 * PRINTS), np.int64)
            for at in range(0, len(own), STEP):
                sums += votes(own[at : at + STEP], weights[at : at + STEP]).sum(0, dtype=np.int64)
            self.prints[j] = fingerprints(sums)[0]
            hashed.append(np.unique(own))
        self.known = np.unique(np.concatenate(hashed))
        self.shift = np.uint64(64 - min(27, max(16, (16 * len(self.known)).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(self.known >> self.shift).astype(np.int64)] = True
        self.sizes, self.of_size = np.unique(self.size, return_inverse=True)
        self.lightest = np.full(len(self.sizes), np.iinfo(np.int64).max)
        np.minimum.at(self.lightest, self.of_size, self.weight)
        self.index = MultiIndex(self.prints)
        self.counted: dict[int, tuple[np.ndarray, Counter]] = {}

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within RADIUS, of items of that size."""
        w, j = self.index.near(prints)
        return w[self.size[j] == size], j[self.size[j] == size]

    def candidates(self, at: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> set[int]:
        """Items whose fingerprint lies near that of an item-sized window that ends at a hit. at: places of the hits."""
        out: set[int] = set()
        total = np.concatenate([[0], np.cumsum(weights)])
        for low in range(0, len(at), STEP):
            ends = np.arange(low, min(len(at), low + STEP))
            starts = np.searchsorted(at, at[ends, None] - self.sizes[None, :] + 1)
            e, d = np.nonzero(total[ends + 1, None] - total[starts] >= THRESHOLD * self.lightest)
            if not len(e):
                continue
            first = starts[e, d]
            base = int(first.min())
            ranges, back = np.unique(first * (len(at) + 1) + ends[e], return_inverse=True)
            a, b = divmod(ranges, len(at) + 1)
            sums = np.zeros((int(ends[-1]) + 2 - base, 64 * PRINTS), np.int64)
            np.cumsum(votes(hashes[base : ends[-1] + 1], weights[base : ends[-1] + 1]), axis=0, out=sums[1:])
            prints = np.concatenate([fingerprints(sums[b[x : x + STEP] + 1 - base] - sums[a[x : x + STEP] - base]) for x in range(0, len(a), STEP)])
            # one look for windows of all sizes; of what is near, items of a window's own sizes stay
            w, j = self.index.near(prints)
            asked = np.unique(back * len(self.sizes) + d)
            out.update(j[np.isin(w * len(self.sizes) + self.of_size[j], asked)].tolist())
        return out

    def shingles_of(self, j: int) -> tuple[np.ndarray, Counter]:
        """An item's shingles: hashes, and how often each comes."""
        if j not in self.counted:
            if len(self.counted) >= REMEMBERED:
                self.counted.clear()
            words = self.texts[j].split()
            self.counted[j] = np.unique(rolling(words)), Counter(shingles(words))
        return self.counted[j]

    def leaks(self, text: str) -> list[tuple[int, float, int]]:
        """(item, similarity, start) of each item found."""
        words = words_of(text)
        h = rolling(words)
        at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)]) if len(self.known) else []
        if not len(at):
            return []
        near = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        at = at[self.known[near] == h[at]]
        if not len(at):
            return []
        met = self.candidates(at, h[at], shingle_sizes(words)[at])
        shingle = (lambda i: b" ".join(words[i : i + WORDS])) if len(words) >= WORDS else (lambda i: b" ".join(words))
        out = []
        for j in sorted(met):
            own, counts = self.shingles_of(j)
            places = [(i, s) for i in at[np.isin(h[at], own)].tolist() if (s := shingle(i)) in counts]
            if sum(min(n, counts[s]) * len(s) for s, n in Counter(s for _, s in places).items()) >= THRESHOLD * self.weight[j]:
                similarity, start = self._best(j, places)
                if similarity >= THRESHOLD:
                    out.append((j, similarity, start))
        return out

    def _best(self, j: int, places: list[tuple[int, bytes]]) -> tuple[float, int]:
        """(similarity, start) of the item's best window, the first of equal ones. A window gains only where its end
        meets a hit, so one window a hit is enough."""
        n, counts, held, weight, tail = int(self.size[j]), self.shingles_of(j)[1], Counter(), 0, 0
        best = (0, 0)
        for i, s in places:
            start = max(0, i - n + 1)
            while places[tail][0] < start:
                gone = places[tail][1]
                weight -= len(gone) if held[gone] <= counts[gone] else 0
                held[gone] -= 1
                tail += 1
            held[s] += 1
            weight += len(s) if held[s] <= counts[s] else 0
            if weight > best[0]:
                best = (weight, start)
        return best[0] / int(self.weight[j]), best[1]


def leaks_of(shared, kind: str, text: str) -> Column:
    """struct<item_id, similarity, start> of arrays, of a text column. shared: a broadcast of items."""
    name = uuid.uuid4().hex

    @F.pandas_udf(f"item_id array<{kind}>, similarity array<double>, start array<bigint>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = resident(("benchmark", name), lambda: Benchmark(shared.value))
        for batch in batches:
            found = [[(i, s, a) for j, s, a in own.leaks(t or "") for i in own.ids[j]] for t in batch]
            yield pd.DataFrame({c: [[x[k] for x in f] for f in found] for k, c in enumerate(("item_id", "similarity", "start"))})

    return find.asNondeterministic()(F.col(text))  # else a filter on its result runs it once more


def slices_of(benchmark: DataFrame, text: str, most: int) -> list[DataFrame]:
    """The items in parts of about that many bytes; not yet collected."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // most))
    return [benchmark.where(F.pmod(F.xxhash64(text), F.lit(n)) == k) for k in range(n)] if n > 1 else [benchmark]


def broadcast_items(part: DataFrame, item_id: str, text: str):
    return part.sparkSession.sparkContext.broadcast([tuple(r) for r in part.select(item_id, text).collect()])


def find_leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    kind = benchmark.schema[item_id].dataType.simpleString()
    parts, out = slices_of(benchmark, item_text, slice_bytes), None
    for part in parts:
        shared = broadcast_items(part, item_id, item_text)
        found = df.select(F.col(doc_id).alias("doc_id"), leaks_of(shared, kind, text).alias("p")).where(F.size("p.item_id") > 0)
        rows = found.select("doc_id", F.explode(F.arrays_zip("p.item_id", "p.similarity", "p.start")).alias("z")).select("doc_id", "z.item_id", "z.similarity", "z.start")
        if len(parts) > 1:
            rows = cut(rows)
            shared.destroy()
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """df without the documents that hold an item."""
    kind = benchmark.schema[item_id].dataType.simpleString()
    parts = slices_of(benchmark, item_text, slice_bytes)
    name = fresh(df, "_leaks")
    if len(parts) == 1:
        shared = broadcast_items(parts[0], item_id, item_text)
        return df.withColumn(name, leaks_of(shared, kind, text)).where(F.size(f"{name}.item_id") == 0).drop(name)
    leaky = None
    for part in parts:
        shared = broadcast_items(part, item_id, item_text)
        found = cut(df.select(F.col(text).alias("text"), leaks_of(shared, kind, text).alias("p")).where(F.size("p.item_id") > 0).select(F.sha2("text", 256).alias(name)).distinct())
        shared.destroy()
        leaky = found if leaky is None else leaky.unionByName(found)
    # written, so that both sides of the join are plain shuffles: Spark then splits a text that many rows share
    return df.withColumn(name, F.sha2(F.col(text), 256)).join(cut(leaky.distinct()), name, "left_anti").drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document against every item."""
    from docforge.llm.common import table

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
