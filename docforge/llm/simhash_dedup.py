"""SimHash near-duplicates: pigeonhole blocks, joins on them, verified Hamming distance, connected components.

Words are runs of anything but ASCII white space, A-Z lower-cased; a shingle is WORDS words joined by spaces. A bit of
the fingerprint is set if it is set in over half of the shingles' XXH64. Rows of equal fingerprint are counted once.

Two fingerprints within RADIUS bits agree in at least ``blocks - RADIUS`` of ``blocks`` blocks, so each is filed under
every choice of that many blocks: no pair can be missed, whatever the number of blocks. More blocks make keys longer
and more numerous; the number is taken from the count of distinct fingerprints so that a key meets few others by chance.
Keys that few share are joined; those that many share (copies that differ a little) are compared in bounded parts
(graph.in_blocks), which give back a spanning set of links and never all pairs.

Result per row: doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links.
Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer words than a
shingle has are one shingle; repeated rows and ids stay rows; a null doc_id counts for no component's name (null if
the component has no other); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import cut, fresh, scratch
from docforge.llm.graph import by_group, components, in_blocks, spanning, spread_join

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints that share a key and are joined pair by pair; larger groups go in parts.
FEW = 32
#: Shingles whose bits are counted at a time.
STEP = 1 << 16


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64 bits."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) > words else [b" ".join(parts)]
    n = max(1, len(parts) - words + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        bits = np.unpackbits(hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint_of(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.asarray([fingerprint(t or "", words, seed) for t in batch], np.uint64).astype(np.int64))

    return run.asNondeterministic()(text)  # else filters that Spark infers run it once more


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """One mask for each choice of blocks - radius blocks, as signed 64-bit integers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(own, blocks - radius))]


def blocks_for(distinct: int, radius: int = RADIUS) -> int:
    """Fewest blocks with which a key meets less than one other fingerprint in four by chance."""
    for blocks in range(radius + 1, 64):
        key_bits = 64 * (blocks - radius) // blocks
        if distinct <= 1 << max(0, key_bits - 2) or blocks == radius + 6:
            return blocks
    return 64


def near_links(prints: DataFrame, distinct: int, radius: int = RADIUS, few: int = FEW) -> DataFrame:
    """Links (a, b) with the components of all pairs of distinct fingerprints fp within radius bits."""
    choices = masks(blocks_for(distinct, radius), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(choices)])
    filed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = filed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(spread_join(filed, sizes, ["t", "key"], distinct * len(choices), "n"))
    rare = met.where(F.col("n") <= few)
    a, b = rare.alias("a"), rare.alias("b")
    close = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    pairs = a.join(b, close).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        side, fp = rows.column("side").to_numpy(), rows.column("node").to_numpy().view(np.uint64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for left, right in ((fp[side == 0], fp[side == 1]), (fp[side == 2],) * 2):
            for at in range(0, len(left), 256):
                x, y = np.nonzero(np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= radius)
                x += at
                apart = left[x] != right[y]
                found.append(spanning(left[x][apart], right[y][apart]))
        a, b = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.uint64),) * 2
        if not len(a):
            return None
        a, b = spanning(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    many = in_blocks(met.where(F.col("n") > few), ["t", "key"], "fp", "n", [])
    return pairs.unionByName(by_group(many, compare, "a bigint, b bigint"))


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) for rows (doc_id, fp): every distinct fingerprint, its component and that one's smallest doc_id."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = distinct.count()
    roots = components(near_links(distinct, n))
    rooted = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("times"))
    return cut(spread_join(rooted, names, ["root"], n, "times").select("fp", "root", "component_id"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    prints = cut(df.select(F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp")))
    named = spread_join(prints, classes(prints), ["fp"], prints.count())
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component: that of the smallest doc_id (null ids last; of equal ones, any).

    Rows are written once with their fingerprint and a number of their own, and fingerprints are read back from there:
    texts are shuffled once, by that number, so that copies go to different tasks.
    """
    spark = df.sparkSession
    fp, row = fresh(df, "_fp"), fresh(df, "_row")
    path = scratch(spark, "fingerprints")
    df.withColumn(fp, fingerprint_of(F.col(text))).withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    marked = spark.read.parquet(path)
    prints = marked.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    firsts = prints.groupBy("fp").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    named = firsts.join(classes(prints.select("doc_id", "fp")).select("fp", "root"), "fp")
    chosen = named.groupBy("root").agg(F.min_by("row", F.struct("first.none", "first.doc_id", "row")).alias(row))
    return marked.join(chosen.select(row), row, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document."""
    from docforge.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
