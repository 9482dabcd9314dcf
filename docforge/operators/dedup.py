"""De-duplication of the corpus cleaner: exact, by key, keep-first and 4-gram Jaccard."""

from __future__ import annotations

import atexit
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions.text import paragraph_key
from docforge.operators.columns import fresh
from docforge.operators.lineage import cut, freed, kept, remove, scratch
from docforge.operators.sequence import in_turn

WINDOW, SIMILARITY, SHORTEST = 120, 0.60, 8
#: What a paragraph key leaves out of a lower-case text.
OTHER = re.compile(r"[^a-z0-9]+")
#: Buckets whose sizes are broadcast, at most.
HOT = 4096
#: Different 4-grams of digits and small letters.
CODES = 36**4
#: Keys times bands that one pass looks at, if these are no tenth of all bands.
AT_ONCE = 2_000_000


def keep_first(rows: DataFrame, key: list[str | Column], order: list[str], always: Column | None = None) -> DataFrame:
    """The first row of each key, and all rows that are exempt. An exempt row gets a key of its own before the shuffle,
    so that blank lines, the most frequent key of all, are no hot group."""
    n = fresh(rows, "_n")
    if always is None:
        return rows.withColumn(n, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(n) == 1).drop(n)
    spread = [F.when(always, F.xxhash64(*order)), always]
    names = [F.when(~always, k if isinstance(k, Column) else F.col(k)) for k in key]
    marked = rows.withColumn(n, F.row_number().over(Window.partitionBy(*names, *spread).orderBy(*order)))
    return marked.where((F.col(n) == 1) | always).drop(n)


def exact_paragraphs(paragraphs: DataFrame, by: list[str], order: list[str], text: str = "line") -> DataFrame:
    """The first of paragraphs whose letters and digits agree; short ones are exempt. Groups are told apart by a digest,
    so that sorting compares few bytes."""
    key = paragraph_key(F.col(text))
    return keep_first(paragraphs, [*by, F.md5(key)], order, F.length(key) < SHORTEST)


def translations(groups: DataFrame, by: list[str], q_num: str = "q_num", images: str = "images", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first group with images of each question; dropped also counts later ones without images."""
    w = Window.partitionBy(*by, q_num).orderBy(order)
    has = F.col(images) > 0
    seen = F.coalesce(F.max(has).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    mark = fresh(groups, "_seen")
    marked = groups.withColumn(mark, seen)
    return marked.where(has & ~F.col(mark)).drop(mark), marked.where(mark).drop(mark)


def topmost(images: DataFrame, by: list[str]) -> DataFrame:
    """The uppermost image of each question."""
    return keep_first(images, by, ["page_idx", "y_rounded", "seq"])


def last_wins(rows: DataFrame, key: list[str], order: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(the last value of each key, log of (key, prev, new) for each overwriting)."""
    w, n = Window.partitionBy(*key).orderBy(*order), fresh(rows, "_n")
    last = rows.withColumn(n, F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order]))).where(F.col(n) == 1).drop(n)
    log = rows.select(*key, *order, F.lag(value).over(w).alias("prev"), F.col(value).alias("new"), F.row_number().over(w).alias("_n")).where("_n > 1").drop("_n")
    return last, log


def greedy_step(window: int = WINDOW, similarity: float = SIMILARITY) -> Callable[[str | None], bool]:
    """A function that is told paragraphs in order and says whether each stays: not one like one of the last kept ones.

    Kept paragraphs are numbered, and each gram lists the numbers it occurs in, newest last: what a paragraph shares with
    those of the window is counted through its own grams, and no two sets are compared. Held are the sizes and grams of
    the window, and eight bytes for each paragraph that was kept (for equal ones, which no window bounds).
    """
    holders: dict[str, list[int]] = {}
    sizes: dict[int, int] = {}
    known: set[int] = set()
    kept = 0

    def stays(text: str | None) -> bool:
        nonlocal kept
        key = OTHER.sub("", (text or "").lower())
        if len(key) < SHORTEST:
            return True
        digest = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little")
        if digest in known:
            return False
        own = {key[i : i + 4] for i in range(len(key) - 3)}
        shared = Counter(chain.from_iterable(map(holders.get, own, repeat(()))))
        if any(k in sizes and n >= similarity * (len(own) + sizes[k] - n) for k, n in shared.items()):
            return False
        known.add(digest)
        for g in own:
            held = holders.setdefault(g, [])
            if held and held[0] not in sizes:
                held[:] = [k for k in held if k in sizes]
            held.append(kept)
        sizes[kept] = len(own)
        sizes.pop(kept - window, None)
        kept += 1
        if kept % (64 * window) == 0:  # grams that no kept paragraph of the window has
            for g in [g for g, held in holders.items() if held[-1] not in sizes]:
                del holders[g]
        return True

    return stays


def greedy_flags(texts: list[str | None], window: int = WINDOW, similarity: float = SIMILARITY) -> list[bool]:
    """Which paragraphs of an ordered list stay."""
    return [*map(greedy_step(window, similarity), texts)]


def greedy_paragraphs(paragraphs: Column, window: int = WINDOW, similarity: float = SIMILARITY) -> Column:
    """array<boolean> for an array of paragraphs in order: the exact, order-bound mode. The array of a document (or of its
    chunks joined in order) is the unit; rows never meet, so there is no shuffle."""

    @F.pandas_udf("array<boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda xs: None if xs is None else greedy_flags(list(xs), window, similarity))

    return run(paragraphs)


def across_chunks(chunks: DataFrame, doc: str = "doc_id", chunk: str = "chunk_index", text: str = "text", mark: str = "\n\n") -> DataFrame:
    """Chunks without paragraphs like one that an earlier chunk of the document kept. Paragraphs are sorted and streamed
    (sequence.in_turn), so a document of any length takes the memory of the window."""
    rows = chunks.select(F.col(doc).alias("d"), F.posexplode(F.split(text, mark)).alias("n", "p"), F.col(chunk).alias("c")).select("d", F.struct("c", "n").alias("o"), "p")
    kept = in_turn(rows, ["d"], "o", ["p"], greedy_step, "stays", "boolean").where("stays")
    paragraphs = rows.join(kept.select("d", "o"), ["d", "o"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o.n", "p"))), lambda x: x["p"]), mark)
    return paragraphs.groupBy(F.col("d").alias(doc), F.col("o.c").alias(chunk)).agg(joined.alias(text))


def _grams_of(key: str) -> np.ndarray:
    """Distinct 4-grams of a paragraph key, which is ASCII: four bytes are one number."""
    raw = np.frombuffer(key.encode(), np.uint8)
    return np.unique(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 4)).view("<u4")[:, 0])


def _sketched(keys: DataFrame, bands: int, per_band: int) -> DataFrame:
    """keys (id, k) with hs, of each band the hash of per_band minima over a paragraph key's grams (four characters at least),
    and sk, two bits of each minimum. Band hashes have thirty-two bits: keys that only share a hash are compared as any others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(17)
        by, plus = (rng.integers(0, 1 << 63, bands * per_band, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        band = np.repeat(np.arange(1, bands + 1, dtype=np.uint64), per_band).reshape(bands, per_band)
        for batch in batches:
            least = np.full((batch.num_rows, bands * per_band), np.iinfo(np.uint64).max)
            for row, k in zip(least, batch.column(1).to_pylist()):
                grams = _grams_of(k).astype(np.uint64)
                for at in range(0, len(grams), 4096):
                    h = grams[at : at + 4096, None] * by + plus
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    np.minimum(row, (h ^ (h >> np.uint64(32))).min(0), out=row)
            mixed = ((least.reshape(-1, bands, per_band) ^ band) * by.reshape(bands, per_band)).sum(2, dtype=np.uint64)
            hs = (mixed ^ (mixed >> np.uint64(31))).astype(np.uint32).view(np.int32)
            sk = np.concatenate([np.packbits((least & np.uint64(bit)) > 0, axis=1) for bit in (1, 2)], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(len(hs) + 1, dtype=np.int32) * bands, pa.array(hs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array([*map(bytes, sk)], pa.binary())], ["id", "k", "hs", "sk"])

    return keys.select("id", "k").mapInArrow(run, "id bigint, k string, hs array<int>, sk binary")


def _keys(rows: DataFrame, key_id: str, text: str, bands: int, per_band: int) -> DataFrame:
    """(id, k, hs, sk): the different paragraph keys, their least ids, bands and sketches; made once."""
    keys = rows.select(F.col(key_id).cast("bigint").alias("id"), paragraph_key(F.col(text)).alias("k")).where(F.length("k") >= SHORTEST)
    return kept(_sketched(keys.groupBy("k").agg(F.min("id").alias("id")), bands, per_band), "keys")


def _deal(filed: DataFrame, total: int, part: int) -> DataFrame:
    """(g, side, and the columns of filed) for rows filed under h: any two rows of an h meet in just one block g of about
    2 * part rows. side tells two parts of an h apart and is 2 where a part meets itself. An h of one row goes."""
    kept = [F.col(c) for c in filed.columns]
    sizes = cut(filed.groupBy("h").agg(F.count("*").alias("met")).where("met > 1"))
    large = F.broadcast(sizes.where(F.col("met") > max(part, total // HOT)))
    rare = filed.join(large.select("h"), "h", "left_anti").join(sizes, "h")
    met = filed.join(large, "h").unionByName(rare).select(*kept, F.ceil(F.col("met") / part).cast("int").alias("parts"))
    return _parted(met, kept)


def _parted(met: DataFrame, kept: list[Column]) -> DataFrame:
    """(kept, g, side) for rows filed under h that come in so many parts."""
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = met.select(*kept, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return dealt.select(*kept, F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("g"), side.alias("side"))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each place's component, with links from a to b added."""
    while (differ := label[a] != label[b]).any():
        a, b = a[differ], b[differ]
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up
    return label


def _linked(g: np.ndarray, side: np.ndarray, ids: np.ndarray, words: list[np.ndarray], apart: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) of rows sorted by g: rows of a g whose sketches (words, first bits before second bits) differ in so many
    places at most are linked, and root is the least id that links reach within the g. Rows without links are left out."""
    half = len(words) // 2

    def near(i, j) -> np.ndarray:
        return sum(np.bitwise_count((words[w][i] ^ words[w][j]) | (words[w + half][i] ^ words[w + half][j])) for w in range(half)) <= apart

    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[starts, len(g)])
    ends = np.repeat(starts + sizes, sizes)
    label, some, gap = np.arange(len(g)), [], 1
    i = np.flatnonzero(np.repeat(sizes <= 64, sizes))
    while len(i := i[i + gap < ends[i]]):  # small groups, all at a time: each row with the next, the one after, ...
        found = i[near(i, i + gap)]
        some.append((found, found + gap))
        gap += 1
    if some:
        label = _merged(label, *(np.concatenate(x) for x in zip(*some)))
    for k in np.flatnonzero(sizes > 64).tolist():
        here = np.arange(starts[k], starts[k] + sizes[k])
        sides = side[here]
        for left, right in ((here[sides == 0], here[sides == 1]), (here[sides == 2],) * 2):
            for p in range(0, len(left), tile):
                for q in range(p if left is right else 0, len(right), tile):
                    x, y = left[p : p + tile], right[q : q + tile]
                    i, j = np.nonzero(near(x[:, None], y[None, :]))
                    label = _merged(label, x[i], y[j])
    least = ids.copy()
    np.minimum.at(least, label, ids)
    linked = (np.bincount(label, minlength=len(g)) > 1)[label]
    return ids[linked], least[label[linked]]


def _roots(keys: DataFrame, bands: int, per_band: int, similarity: float, part: int) -> DataFrame:
    """(id, roots): keys that may be alike have a root in common. Two keys that share a band's bucket, and whose sketches say
    that they may be alike, get the least id of such keys of the bucket as a root; texts stay where they are.

    Sketches of keys at ``similarity`` agree in similarity + (1 - similarity) / 4 of their places on average; they may agree
    in four standard deviations fewer (two pairs in a hundred thousand agree in fewer still, at 0.60 and 160 places). Some
    bands at a time are looked at, and leave no shuffle files, so what is on disk at once is a tenth of all buckets."""
    spark, places = keys.sparkSession, bands * per_band
    agree = similarity + (1 - similarity) / 4
    apart = places - int(places * agree - 4 * (places * agree * (1 - agree)) ** 0.5)
    total = keys.count()
    passes = -(-bands // max(-(-bands // 10), min(bands, AT_ONCE // max(1, total))))
    step, most = -(-bands // passes), max(part, total * -(-bands // passes) // HOT)
    wide = -(-places // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(g: np.ndarray, side: np.ndarray, ids: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
            bits = np.zeros((len(sk), 2, -(-wide // 8) * 8), np.uint8)
            bits[:, :, :wide] = sk.reshape(-1, 2, wide)
            words = [np.ascontiguousarray(x) for x in bits.reshape(len(sk), -1).view(np.uint64).T]
            return pa.RecordBatch.from_arrays([*map(pa.array, _linked(g, side, ids, words, apart))], ["id", "root"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sk = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, 2 * wide)
            now = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)), sk]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = np.searchsorted(now[0], now[0][-1])
            if last:
                yield told(*(x[:last] for x in now))
            held = [x[last:] for x in now]
        if held is not None:
            yield told(*held)

    path, n = scratch(spark, "met"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for at in range(0, bands, step):
        filed = keys.select("id", "sk", F.explode(F.slice("hs", at + 1, step)).alias("h"))
        large = cut(filed.groupBy("h").agg(F.count("*").alias("met")).where(F.col("met") > most))
        parts = F.coalesce(F.ceil(F.col("met") / most), F.lit(1)).cast("int")
        met = filed.join(F.broadcast(large), "h", "left").select("id", "sk", "h", parts.alias("parts"))
        dealt = _parted(met, [F.col("id"), F.col("sk"), F.col("h")]).select("g", "side", "id", "sk")
        dealt.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "id bigint, root bigint").write.mode("append").parquet(path)
    roots = cut(spark.read.schema("id bigint, root bigint").parquet(path).groupBy("id").agg(F.collect_set("root").alias("roots")))
    remove(spark, path)
    return roots


def _matched(keys: DataFrame, bands: int, per_band: int, similarity: float, part: int, as_pairs: bool) -> DataFrame:
    """What _alike gives of all keys, computed once (counts summed by key). Texts are moved for keys that may be alike to some
    other, once a root; roots are taken some at a time, so that about a fifth of all keys' texts are on the way at once."""
    spark = keys.sparkSession
    known = kept(_roots(keys, bands, per_band, similarity, 4 * part).join(keys.select("id", "k"), "id"), "known")
    total = known.agg(F.coalesce(F.sum(F.size("roots")), F.lit(0))).first()[0]
    passes = max(1, -(-total // max(AT_ONCE // 10, keys.count() // 5)))
    path = scratch(spark, "alike")
    atexit.register(remove, spark, path)
    for at in range(passes):
        filed = known.select("*", F.explode("roots").alias("h")).where(F.pmod(F.xxhash64("h"), F.lit(passes)) == at)
        large = cut(filed.groupBy("h").agg(F.count("*").alias("met")).where(F.col("met") > max(part, total // passes // HOT)))
        parts = F.coalesce(F.ceil(F.col("met") / part), F.lit(1)).cast("int").alias("parts")
        met = filed.join(F.broadcast(large), "h", "left").select("h", "id", F.filter("roots", lambda x: x < F.col("h")).alias("before"), "k", parts)
        blocks = _parted(met, [F.col(c) for c in ("h", "id", "before", "k")]).select("g", "side", "h", "id", "before", "k")
        alike = _alike(blocks, similarity, as_pairs)
        (alike if as_pairs else alike.groupBy("a").agg(F.sum("x").alias("x"))).write.mode("append").parquet(path)
    return spark.read.schema("a bigint, b bigint, x double" if as_pairs else "a bigint, x double").parquet(path)


def _compared(blocks: DataFrame, compare: Callable[[list[tuple]], Iterator[tuple]]) -> DataFrame:
    """(a, b, x): what compare says of the rows of each block g, without their g. A task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            now, held = None, []
            for batch in batches:
                for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if g != now:
                        yield from compare(held) if len(held) > 1 else ()
                        now, held = g, []
                    held.append(tuple(row))
            yield from compare(held) if len(held) > 1 else ()

        some = made()
        while got := list(islice(some, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "x"])

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint, x double")


def _alike(blocks: DataFrame, similarity: float, as_pairs: bool) -> DataFrame:
    """(a, b, similarity) of what is alike, or (a, b: null, how many a is like) of a block. What is compared never leaves
    its block: pairs that aren't alike are no rows. Two keys that share several roots count in the least of them."""

    def common(x: list[list], y: list[list]) -> np.ndarray:
        """Which of x have a root in common with which of y."""
        names = {r: c for c, r in enumerate({r for some in x for r in some} & {r for some in y for r in some})}
        held = [np.zeros((len(some), len(names)), np.float32) for some in (x, y)]
        for to, some in zip(held, (x, y)):
            for i, rs in enumerate(some):
                to[i, [names[r] for r in rs if r in names]] = 1
        return held[0] @ held[1].T > 0

    def two(one: tuple, other: tuple) -> Iterator[tuple]:
        """A block of two rows, as most are."""
        if one[1] == other[1] and one[2] != other[2] and set(one[3]).isdisjoint(other[3]):
            x, y = _grams_of(one[4]), _grams_of(other[4])
            n = len(np.intersect1d(x, y, assume_unique=True))
            if n / (len(x) + len(y) - n) >= similarity:
                a, b = sorted((one[2], other[2]))
                yield from ((a, b, n / (len(x) + len(y) - n)),) if as_pairs else ((a, None, 1.0), (b, None, 1.0))

    def compare(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) == 2:
            yield from two(*rows)
            return
        sides, hs, ids = (np.asarray([r[i] for r in rows]) for i in (0, 1, 2))
        sets = [_grams_of(r[4]) for r in rows]
        sizes = np.asarray([len(x) for x in sets])
        for h in np.unique(hs).tolist():  # one, unless two blocks share a digest
            here = hs == h
            for left, right in ((np.flatnonzero(here & (sides == 0)), np.flatnonzero(here & (sides == 1))), (np.flatnonzero(here & (sides == 2)),) * 2):
                if not len(left) or not len(right):
                    continue
                whole = left is right
                if len(left) * len(right) > 4096:  # fewer columns than grams tell most that are unlike
                    least = (sizes[left][:, None] + sizes[right][None, :]) * (similarity / (1 + similarity)) - 1e-6
                    left, right, _, _ = _narrowed(left, right, (_at_most(left, right, [r[4] for r in rows], sizes) >= least) & (ids[left][:, None] != ids[right][None, :]), least)
                    if not len(left) or not len(right):
                        continue
                used = np.union1d(left, right)
                names, at = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
                row = np.repeat(np.arange(len(used)), sizes[used])
                total = np.zeros((len(left), len(right)), np.float32)
                x, y = np.searchsorted(used, left), np.searchsorted(used, right)
                for low in range(0, len(names), 8192):
                    mine = (at >= low) & (at < low + 8192)
                    held = np.zeros((len(used), min(8192, len(names) - low)), np.float32)
                    held[row[mine], at[mine] - low] = 1
                    total += held[x] @ held[y].T
                union = sizes[left][:, None] + sizes[right][None, :] - total
                like = (total / union >= similarity) & (ids[left][:, None] != ids[right][None, :])
                if whole:
                    like &= left[:, None] < right[None, :]
                like &= ~common([rows[i][3] for i in left], [rows[i][3] for i in right])
                p, q = np.nonzero(like)
                a, b = ids[left[p]], ids[right[q]]
                if as_pairs:
                    yield from zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), (total[p, q].astype(float) / union[p, q]).tolist())
                else:
                    one, n = np.unique(np.concatenate([a, b]), return_counts=True)
                    yield from zip(one.tolist(), [None] * len(one), n.astype(float).tolist())

    return _compared(blocks, compare)


def _raw_codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the 4-grams of paragraph keys: four of 36 digits and letters are a number below CODES."""
    raw = np.frombuffer("".join(keys).encode(), np.uint8).astype(np.int32)
    digit = np.where(raw < ord("a"), raw - ord("0"), raw - ord("a") + 10)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    inside = row[:-3] == row[3:]
    code = ((digit[:-3] * 36 + digit[1:-2]) * 36 + digit[2:-1]) * 36 + digit[3:]
    return row[:-3][inside], code[inside]


def _codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct 4-grams of paragraph keys, by row."""
    row, code = _raw_codes(keys)
    both = np.unique(row * CODES + code)
    return both // CODES, both % CODES


def _runs(batches: Iterator[pa.RecordBatch], letters: int = 1 << 18) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(ids, keys) of batches, about so many letters at a time."""
    for batch in batches:
        ids, ks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        ends = np.cumsum([len(k) for k in ks]) // letters
        for at in np.split(np.arange(len(ks)), np.flatnonzero(np.diff(ends)) + 1) if ks else ():
            yield ids[at], [ks[i] for i in at.tolist()]


def gram_ranks(keys: DataFrame) -> np.ndarray:
    """The place of each 4-gram in the order of how many paragraph keys k hold it, rarest first. There are CODES = 36 ** 4
    grams whatever the table: tasks give back a count a gram, and 7 MB of places is what workers get."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES, np.int64)
        for _, ks in _runs(batches):
            code, n = np.unique(_codes(ks)[1], return_counts=True)
            total[code] += n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["c", "n"])

    met = keys.select("id", "k").mapInArrow(count, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    code, n = (met.column(c).to_numpy() for c in ("c", "n"))
    ranks = np.zeros(CODES, np.int32)
    ranks[code[np.lexsort((code, n))]] = np.arange(len(code), dtype=np.int32)
    return ranks


def _exactly_alike(rows: DataFrame, key_id: str, text: str, similarity: float, part: int, as_pairs: bool) -> tuple[DataFrame, DataFrame]:
    """(keys, what _alike gives) by prefixes. The grams of a key are put in order, rarest first. Keys of n and m grams that
    are alike share ceil(similarity * n) grams or more, so one of the first n - ceil(similarity * n) + 1 of each: keys are
    filed under those, and meet in the blocks of each. In a block two keys count only if its gram is the first they share,
    and are compared only if their sizes, what is left of them from that gram on, and a bitmap of their grams allow them
    to be alike."""
    spark = rows.sparkSession
    made = rows.select(F.col(key_id).cast("bigint").alias("id"), paragraph_key(F.col(text)).alias("k")).where(F.length("k") >= SHORTEST)
    keys = cut(made.groupBy("k").agg(F.min("id").alias("id")))
    ranks = spark.sparkContext.broadcast(gram_ranks(keys))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ks in _runs(batches):
            row, code = _codes(ks)
            rank = ranks.value[code]
            order = np.lexsort((rank, row))
            row, rank, n = row[order], rank[order], np.bincount(row, minlength=len(ks))
            rest = n[row] - np.arange(len(row)) + (np.cumsum(n) - n)[row]
            first = rest >= np.ceil(similarity * n - 1e-9)[row]
            columns = (ids[row[first]], pa.int64()), (rank[first], pa.int32()), (n[row[first]], pa.int32()), (rest[first], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], ["id", "h", "n", "rest"])

    def compare(held: list[tuple]) -> Iterator[tuple]:
        grams = np.asarray([r[1] for r in held])
        for h in np.unique(grams).tolist():  # one, unless two blocks share a digest
            here = [held[i] for i in np.flatnonzero(grams == h)]
            side, ids = np.asarray([r[0] for r in here]), np.asarray([r[2] for r in here])
            size, rest = (np.asarray([r[i] for r in here]) for i in (3, 4))
            for left, right in ((np.flatnonzero(side == 0), np.flatnonzero(side == 1)), (np.flatnonzero(side == 2),) * 2):
                if not len(left) or not len(right):
                    continue
                least = (size[left][:, None] + size[right][None, :]) * (similarity / (1 + similarity)) - 1e-6
                may = np.minimum(rest[left][:, None], rest[right][None, :]) >= least
                if left is right:
                    may = np.triu(may, 1)
                may &= ids[left][:, None] != ids[right][None, :]
                if not may.any():
                    continue
                left, right, may, least = _narrowed(left, right, may, least)
                keys = [r[5] for r in here]
                may &= _at_most(left, right, keys, size) >= least
                if not may.any():
                    continue
                left, right, may, least = _narrowed(left, right, may, least)
                shared, before = _shared(left, right, keys, ranks.value, h)
                i, j = np.nonzero(may & (before == 0) & (shared / (size[left][:, None] + size[right][None, :] - shared) >= similarity))
                a, b, both = ids[left[i]], ids[right[j]], shared[i, j].astype(float)
                if as_pairs:
                    yield from zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), (both / (size[left[i]] + size[right[j]] - both)).tolist())
                else:
                    one, n = np.unique(np.concatenate([a, b]), return_counts=True)
                    yield from zip(one.tolist(), [None] * len(one), n.astype(float).tolist())

    filed = keys.select("id", "k").mapInArrow(prefixes, "id bigint, h int, n int, rest int")
    filed = cut(filed)
    laid = _deal(filed, filed.count(), part)
    return keys, _compared(laid.join(keys, "id").select("g", "side", "h", "id", "n", "rest", "k"), compare)


def _narrowed(left: np.ndarray, right: np.ndarray, may: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Without rows and columns that may be alike to nothing."""
    one, other = may.any(1), may.any(0)
    return left[one], right[other], may[one][:, other], least[one][:, other]


def _places(left: np.ndarray, right: np.ndarray, keys: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The keys of left and right, and where they are among these."""
    used = np.union1d(left, right)
    return [keys[i] for i in used.tolist()], np.searchsorted(used, left), np.searchsorted(used, right)


def _at_most(left: np.ndarray, right: np.ndarray, keys: list[str], size: np.ndarray, bits: int = 1024) -> np.ndarray:
    """An upper bound of what each of left has in common with each of right: bits that only one of two has stand for as many
    grams that only it has."""
    some, x, y = _places(left, right, keys)
    row, code = _raw_codes(some)
    held = np.zeros((len(some), bits), np.float32)
    held[row, (code.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - bits.bit_length() + 1)] = 1
    n = held.sum(1)
    return held[x] @ held[y].T + np.minimum((size[left] - n[x])[:, None], (size[right] - n[y])[None, :])


def _shared(left: np.ndarray, right: np.ndarray, keys: list[str], ranks: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """How many grams each of left has in common with each of right, and how many of these are rarer than h; by products of
    0 and 1 over grams that two rows have, some thousand at a time."""
    some, x, y = _places(left, right, keys)
    row, code = _codes(some)
    both, before = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    names, at, n = np.unique(code, return_inverse=True, return_counts=True)
    for total, wanted in ((both, n > 1), (before, (n > 1) & (ranks[names] < h))):
        place = np.cumsum(wanted) - 1
        for low in range(0, int(wanted.sum()), 4096):
            now = (wanted & (place >= low) & (place < low + 4096))[at]
            held = np.zeros((len(some), 4096), np.float32)
            held[row[now], place[at[now]] - low] = 1
            total += held[x] @ held[y].T
    return both, before


def exact_pairs(rows: DataFrame, key_id: str, text: str, similarity: float = SIMILARITY, part: int = 1024) -> DataFrame:
    """(a, b, similarity) of different paragraph keys that are alike, all of them: an exact join of sets by prefix, size and
    place filters. key_id is a whole number; null texts and short keys are like nothing.

    A key is filed under some 40 of 100 grams at similarity 0.60, and there are 36 ** 4 grams at most, so blocks grow with
    the table: this is for tables of some million keys, ``near_pairs`` for larger ones."""
    return _exactly_alike(rows, key_id, text, similarity, part, True)[1].withColumnRenamed("x", "similarity")


def exact_groups(rows: DataFrame, key_id: str, text: str, similarity: float = SIMILARITY, part: int = 1024) -> DataFrame:
    """As ``near_groups``, with exact counts (see ``exact_pairs``): blocks give back counts, never pairs."""
    keys, alike = _exactly_alike(rows, key_id, text, similarity, part, False)
    return _rows_of(rows, keys, alike, key_id, text)


def near_pairs(rows: DataFrame, key_id: str, text: str, similarity: float = SIMILARITY, bands: int = 40, per_band: int = 4, part: int = 512) -> DataFrame:
    """(a, b, similarity) of different paragraph keys: MinHash bands, then the exact Jaccard of 4-grams. key_id is a whole number.

    The scalable mode: a pair at 0.60 is missed by all bands four times in a thousand. Equal keys are one row, their
    least id. Keys that share a bucket meet by their sketches first (see _roots), and only those that may be alike meet with
    their texts. A bucket or root of many keys is dealt in parts, and two parts at a time are compared in one task: every
    pair is still met, and no block has more than about 2 * part rows (8 * part of sketches). Buckets that hold over 1/HOT
    of all rows learn their size by a broadcast of HOT rows at most. Pairs that are alike are all returned, so a group
    of n like but different texts has up to n * (n - 1) / 2 rows; ``near_groups`` has n.
    """
    with freed(rows.sparkSession):
        alike = _matched(_keys(rows, key_id, text, bands, per_band), bands, per_band, similarity, part, True)
    return alike.withColumnRenamed("x", "similarity")


def near_groups(rows: DataFrame, key_id: str, text: str, similarity: float = SIMILARITY, bands: int = 40, per_band: int = 4, part: int = 512) -> DataFrame:
    """(id, representative, n_like): every row with the least id of its paragraph key, and how many other keys that one is
    like; short keys are like none. Blocks give back counts, so a group of n like keys is n rows of each block at most.
    Rows meet their key's figures in one join, whose large keys Spark can split; short keys, the commonest, take none."""
    with freed(rows.sparkSession):
        keys = _keys(rows, key_id, text, bands, per_band)
        alike = _matched(keys, bands, per_band, similarity, part, False)
    return _rows_of(rows, keys, alike, key_id, text)


def _rows_of(rows: DataFrame, keys: DataFrame, alike: DataFrame, key_id: str, text: str) -> DataFrame:
    """(id, representative, n_like) of rows, from what blocks counted of their keys; rows and keys meet by a digest."""
    digest = F.unhex(F.md5("k")).alias("d")
    likes = alike.groupBy(F.col("a").alias("id")).agg(F.sum("x").cast("bigint").alias("n_like"))
    heads = keys.select(digest, "id").join(likes, "id", "left").select("d", F.col("id").alias("representative"), "n_like")
    keyed = rows.select(F.col(key_id).alias("id"), paragraph_key(F.col(text)).alias("k"))
    long = F.coalesce(F.length("k") >= SHORTEST, F.lit(False))
    alone = keyed.where(~long).select("id", F.col("id").alias("representative"), F.lit(0).cast("bigint").alias("n_like"))
    return keyed.where(long).select("id", digest).join(heads, "d").select("id", "representative", F.coalesce("n_like", F.lit(0).cast("bigint")).alias("n_like")).unionByName(alone)


def blocks_before_rendering(blocks: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Blocks of a document as they are drawn: blank ones go, headings come once whatever their case, other texts once, and
    not if they are like one of the last kept ones (greedy_step over sorted, streamed rows)."""
    rows = blocks.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    heading = F.upper("tag").isin("H1", "H2", "H3", "HEADING")
    asked, kept = fresh(rows, "_asked"), fresh(rows, "_stays")
    flags = in_turn(rows.withColumn(asked, F.when(~heading, F.col("content"))), by, order, [asked], greedy_step, kept, "boolean").where(kept)
    kept = rows.join(flags.select(*by, order), [*by, order], "left_semi")
    key = F.when(heading, F.concat(F.lit("h:"), F.lower(F.trim("content")))).otherwise(F.concat(F.lit("b:"), F.trim("content")))
    return keep_first(kept, [*by, F.md5(key)], [order])
