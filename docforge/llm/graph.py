"""Work on links that no driver or single task could hold: buckets in bounded blocks, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import cut, partitions

#: Rows of a bucket that one task compares with as many others at a time.
BLOCK = 2048
#: Keys of a join whose rows are broadcast at most (some 100 bytes each).
HOT = 4096


def in_blocks(members: DataFrame, bucket: list[str], node: str, size: str, carry: list[str], block: int = BLOCK) -> DataFrame:
    """Rows (g, side, node, *carry), laid out so that any two rows of a bucket meet in just one group g.

    A bucket of n rows is dealt over ceil(n / block) parts by a hash of the node; each row goes to the pairs of parts
    that its own belongs to. A group has about 2 * block rows at most, however large its bucket is. side tells the two
    parts of a pair apart (0 and 1); it is 2 where a part meets itself.
    """
    parts = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(F.col(node), F.lit(7)), parts).cast("int")
    dealt = members.select("*", own.alias("_own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other"))
    group = F.xxhash64(*bucket, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return dealt.select(group.alias("g"), F.when(F.col("_own") == F.col("_other"), 2).otherwise((F.col("_own") > F.col("_other")).cast("int")).alias("side"), F.col(node).alias("node"), *carry)


def by_group(rows: DataFrame, compare: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """compare's output for the rows of each g. Two buckets whose g collide are compared together, which adds nothing false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else [0]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if k or (held and held[-1].column(0)[0].as_py() != g[0]):
                    if held and (out := compare(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, schema)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each node that is not its component's least, and that one."""
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[other], names[label[other]]


def spread_join(many: DataFrame, one: DataFrame, key: list[str], rows: int, counted: str | None = None, hot: int = HOT) -> DataFrame:
    """many joined to one, which has one row for each key.

    Keys that hold over rows / hot of many's rows (and over BLOCK) are joined by a broadcast of their rows of one, so that
    many's rows stay dealt as they lie; there are hot of them at most, which bounds the broadcast. The others are
    shuffled. counted: a column of one that says how many rows of many have the key; else they are counted.
    """
    most = max(BLOCK, rows // hot)
    if counted:
        one = cut(one)
        large = one.where(F.col(counted) > most)
    else:
        counts = many.groupBy(*key).agg(F.count("*").alias("_times")).where(F.col("_times") > most).select(*key)
        large = cut(one.join(F.broadcast(counts), key, "left_semi"))
    if large.isEmpty():
        return many.join(one, key)
    there = many.join(F.broadcast(large), key)
    return there.unionByName(many.join(F.broadcast(large.select(*key)), key, "left_anti").join(one, key))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): the least node reachable. Rows for linked nodes only, roots included.

    Large-star and small-star rounds: each keeps the components, the links become stars around the least nodes, and the
    number of links never grows. Nothing is collected but a count and a checksum. The least neighbour of a node is found
    by partial sums before the shuffle, and brought to the links of hubs by a bounded broadcast (spread_join).
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = state(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("times")).select("a", F.least("a", "low").alias("low"), "times")
        large = cut(spread_join(both, least, ["a"], 2 * last[0], "times").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("times"))
        small = spread_join(large, low, ["a"], last[0], "times").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = cut(small)
        now = state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
