"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosines.

A normalised vector v is hashed as floor((a . v + b) / WIDTH) with a normal and b uniform; PROJECTIONS such values are
a bucket, in each of TABLES tables. Vectors of cosine c are sqrt(2 - 2c) apart, so two at the threshold share a given
bucket with the probability ``collision`` to the power PROJECTIONS; TABLES is chosen so that they miss each other in
all tables once in a thousand times at most. What meets in a bucket is compared by its exact cosine in double precision,
in bounded parts (graph.in_blocks) however large the bucket. A link is counted in the first table where its ends meet.

Equal vectors of a label are one class with its number of rows, so copies are never paired. Tables and buckets are met by
class numbers of eight bytes; a vector, in the type it came in, goes only to the buckets where it meets another. Rows
find their class by a 128-bit digest of label and vector. Result per row: vec_id, n_links, component_id (smallest vec_id
reachable), kept.

Defined results: rows whose label or vector is null, whose vector is empty, zero or holds null or non-finite components
have no links and are their own component; so does a row that nothing else is like. Vectors of other lengths don't
link. Repeated rows are rows that link with each other; a null vec_id names no component (kept is then false). An
empty table gives no rows; other columns are not read. Cosines a rounding error from the threshold fall either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import cut
from docforge.llm.graph import BLOCK, by_group, components, in_blocks, spanning, spread_join

THRESHOLD = 0.98
WIDTH, PROJECTIONS, SEED, MISSES = 1.6, 14, 20, 1e-3


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors that far apart get the same value of one projection."""
    if distance <= 0:
        return 1.0
    s = width / distance
    return math.erf(s / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * s) * (1 - math.exp(-s * s / 2))


def tables_for(threshold: float, width: float = WIDTH, projections: int = PROJECTIONS, misses: float = MISSES) -> int:
    met = collision(math.sqrt(max(0.0, 2 - 2 * threshold)), width) ** projections
    return 1 if met >= 1 else math.ceil(math.log(misses) / math.log(1 - met))


@lru_cache(maxsize=8)
def projections(dims: int, tables: int, per_table: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a: dims x values, b: values, multipliers: per_table), the same on every worker."""
    rng = np.random.default_rng([seed, dims])
    return rng.standard_normal((dims, tables * per_table)), rng.uniform(0, width, tables * per_table), rng.integers(1, 1 << 63, per_table, dtype=np.uint64) | np.uint64(1)


def hashes(unit: np.ndarray, tables: int, per_table: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit bucket for each row and table."""
    a, b, by = projections(unit.shape[1], tables, per_table, width, seed)
    values = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, per_table)
    mixed = (values * by).sum(2, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _units(vectors: pa.Array) -> list[np.ndarray]:
    """Normalised rows, grouped by nothing: one array each."""
    out = []
    for v in vectors.to_pylist():
        x = np.asarray(v, np.float64)
        top = np.abs(x).max()
        x = x / top
        out.append(x / math.sqrt(float(x @ x)))
    return out


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, width: float = WIDTH, per_table: int = PROJECTIONS, misses: float = MISSES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    tables = tables_for(threshold, width, per_table, misses)
    kind = df.schema[embedding].dataType.elementType.simpleString()
    v = F.col(embedding) if kind in ("float", "double") else F.col(embedding).cast("array<double>")
    rows = df.select(F.col(vec_id).alias("vec_id"), v.alias("v"), F.col(label).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    kinds = rows.where("usable").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    digest = F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64("v", F.lit(SEED), "label").alias("b"))
    kinds = cut(kinds.select("*", F.monotonically_increasing_id().alias("cid"), digest.alias("digest"), F.xxhash64("label").alias("mark")))
    total = kinds.agg(F.sum("n")).first()[0] or 0

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1))
            sizes = np.asarray([len(u) for u in units])
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                h = hashes(np.stack([units[i] for i in own]), tables, per_table, width, seed)
                cid, mark = (np.repeat(batch.column(c).to_numpy()[own], tables) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(mark), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(np.full(len(cid), dims, np.int32)), pa.array(h.reshape(-1))], ["cid", "mark", "t", "dims", "h"])

    # the label comes as a hash made on the JVM side: it may be of any type
    filed = kinds.select("cid", "v", "mark").mapInArrow(file, "cid bigint, mark bigint, t int, dims int, h bigint")
    filed = cut(filed.select("cid", "t", F.xxhash64("h", "dims", "mark").alias("h")))
    sizes = filed.groupBy("t", "h").agg(F.count("*").alias("met")).where("met > 1")
    met = spread_join(filed, sizes, ["t", "h"], total * tables, "met")
    members = met.join(kinds.select("cid", "v", F.col("mark").alias("label_hash"), F.col("n").alias("own")), "cid")
    laid = in_blocks(members, ["t", "h"], "cid", "met", ["t", "h", "label_hash", "own", "v"], block)

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        side = group.column("side").to_numpy()
        cid, own, h, t, mark = (group.column(c).to_numpy() for c in ("node", "own", "h", "t", "label_hash"))
        units = _units(group.column("v").combine_chunks())
        counts: dict[int, int] = {}
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for dims, table, bucket in {(len(u), int(a), int(b)) for u, a, b in zip(units, t, h)}:
            here = np.asarray([len(u) == dims for u in units]) & (t == table) & (h == bucket)
            own_hashes = hashes(np.stack([units[i] for i in np.flatnonzero(here)]), tables, per_table, width, seed)[:, :table] if table else None
            at_row = np.cumsum(here) - 1
            for left, right in ((np.flatnonzero(here & (side == 0)), np.flatnonzero(here & (side == 1))), (np.flatnonzero(here & (side == 2)),) * 2):
                if not len(left) or not len(right):
                    continue
                x, y = np.stack([units[i] for i in left]), np.stack([units[i] for i in right])
                for at in range(0, len(left), 512):
                    i, j = np.nonzero(x[at : at + 512] @ y.T >= threshold)
                    i, j = left[i + at], right[j]
                    good = (mark[i] == mark[j]) & (cid[i] != cid[j]) & ((side[i] < 2) | (i < j))
                    i, j = i[good], j[good]
                    if table and len(i):
                        first = np.concatenate([~(own_hashes[at_row[i[k : k + 65536]]] == own_hashes[at_row[j[k : k + 65536]]]).any(1) for k in range(0, len(i), 65536)])
                        i, j = i[first], j[first]
                    if not len(i):
                        continue
                    total = np.bincount(np.concatenate([i, j]), np.concatenate([own[j], own[i]]).astype(np.float64), len(cid)).astype(np.int64)
                    for k in np.flatnonzero(total):
                        counts[int(cid[k])] = counts.get(int(cid[k]), 0) + int(total[k])
                    ends.append(spanning(cid[i], cid[j]))
        if not counts:
            return None
        a, b = spanning(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
        n = len(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.fromiter(counts, np.int64, n), a])), pa.array(np.concatenate([np.full(n, -1), b]).astype(np.int64)), pa.array(np.concatenate([np.fromiter(counts.values(), np.int64, n), np.zeros(len(a), np.int64)]))],
            ["a", "b", "n"],
        )

    found = cut(by_group(laid, compare, "a bigint, b bigint, n bigint"))
    links = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b >= 0").select("a", "b")).withColumnRenamed("node", "cid")
    named = cut(kinds.join(links, "cid", "left").join(roots, "cid", "left").select("digest", "n", "least", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "cid").alias("root")))
    names = named.groupBy("root").agg(F.min("least").alias("name"), F.count("*").alias("times"))
    answers = spread_join(named, names, ["root"], total, "times").select("digest", "n", (F.col("n") - 1 + F.col("others")).cast("long").alias("n_links"), F.col("name").alias("component_id"))
    usable_rows = spread_join(rows.where("usable").select("vec_id", digest.alias("digest")), answers, ["digest"], total, "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every embedding."""
    from docforge.llm.common import table

    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE label IS NOT NULL AND len(embedding) > 0
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id"""
