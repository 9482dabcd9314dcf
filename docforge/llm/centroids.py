"""Centroid clustering of whole-number vectors with Elkan's bounds, exact to the last unit.

Vectors become whole numbers once (floor(scale * x)), so that squared distances and sums are exact and no order of rows or
of tasks can change a result. Each vector keeps its cluster, an upper bound of its distance to that centroid and a lower
bound of the distance to every other one. A round moves the bounds by how far centroids moved, and computes the distance to
a centroid only where neither its lower bound nor half the distance between the two centroids proves it farther. Bounds are
square roots in floating point, rounded away from each other, and prune only where they are strictly apart: a centroid that
may be as near is computed, and of equal exact distances the smaller number wins.

A round is one pass over the table of vectors and bounds, which is written for the next round, whose tasks read it. Tasks
add up their vectors by cluster, so nothing is shuffled but a row for each task and cluster; at most k rows reach the
driver. Broadcast are the centroids, k by dims numbers. A cluster of any size is no group of any stage.

Defined results: vectors that are null, of another length, or hold null or non-finite components have no row. Fewer usable
vectors than k give as many centroids, none give no rows. Repeated rows are vectors of their own; rows that share an id are
ordered by their vectors where starts are chosen, rows without an id come last there. Empty clusters keep their centroid.
Other columns are not read. Components beyond LARGEST would need distances beyond a long and are an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import remove, scratch

K, ROUNDS, DIMS, SCALE, SALT = 40, 5, 64, 256, "2:"
STATE = "vec_id {id}, v array<int>, cluster int, upper double, lower array<float>, distance bigint, total array<bigint>, n bigint"


def largest(dims: int) -> int:
    """The largest component (either sign) whose squared distances always fit a long."""
    return math.isqrt((2**63 - 1) // (4 * dims)) - 1


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors in whole numbers; an error where one is too large."""
    e = F.col(embedding)
    usable = (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    most = largest(dims)
    too_large = F.raise_error(F.lit(f"a component is beyond {most}: its squared distances need not fit a long"))
    whole = F.transform(e, lambda x: F.when(F.abs(x.cast("double") * scale) <= most, F.floor(x.cast("double") * scale).cast("int")).otherwise(too_large.cast("int")))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).alias("vec_id"), whole.alias("v"))


def start_rows(vectors: DataFrame, k: int, salt: str = SALT) -> np.ndarray:
    """The k vectors of least sha256 of salt and id, in that order: k rows reach the driver."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("o"), "v").orderBy(F.asc_nulls_last("o"), "v").limit(k).collect()
    return np.asarray([r.v for r in rows], np.int64)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def apart(centroids: np.ndarray) -> np.ndarray:
    """Half the distance between each two centroids, rounded down."""
    square = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    return down(down(np.sqrt(square.astype(np.float64))) / 2)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid, or each to its own."""
    return ((v - c) ** 2).sum(1)


def assign(v: np.ndarray, centroids: np.ndarray, half: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, upper, distances computed): the nearest centroid of each row, ties to the smaller number. lower is changed in place.

    upper and lower bound the distances to the centroids as they are now; half is what ``apart`` says of them.
    """
    k, rows = len(centroids), len(v)
    cluster, upper = cluster.copy(), upper.copy()
    best = np.full(rows, -1, np.int64)
    nearest_other = np.where(np.eye(k, dtype=bool), np.inf, half).min(1) if k > 1 else np.full(1, np.inf)
    todo = np.flatnonzero(~(upper < nearest_other[cluster]))
    best[todo] = squares(v[todo], centroids[cluster[todo]])
    root = np.sqrt(best[todo].astype(np.float64))
    upper[todo] = up(root)
    lower[todo, cluster[todo]] = down(root)
    computed = len(todo)
    for j in range(k):
        own = cluster[todo]
        here = todo[(own != j) & ~(upper[todo] < lower[todo, j]) & ~(upper[todo] < half[own, j])]
        if not len(here):
            continue
        found = squares(v[here], centroids[j])
        computed += len(here)
        root = np.sqrt(found.astype(np.float64))
        lower[here, j] = down(root)
        nearer = (found < best[here]) | ((found == best[here]) & (j < cluster[here]))
        at = here[nearer]
        cluster[at], best[at], upper[at] = j, found[nearer], up(root[nearer])
    return cluster, upper, computed


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def one_round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, id_type: str, last: bool) -> DataFrame:
    """The state after assigning every vector, and a row a task and cluster with the sum of its vectors. moved: how far each
    centroid went since the bounds held, rounded up; None in the first round, when there are no bounds."""
    half, (k, dims) = apart(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        id_kind = None
        for batch in batches:
            ids, id_kind = batch.column(0), batch.column(0).type
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), dims, np.int64)
            if moved is None:
                cluster, upper, lower = np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros((len(v), k))
            else:
                cluster, lower = batch.column(2).to_numpy().astype(np.int64), down(_matrix(batch.column(4), k, np.float64) - moved)
                upper = up(batch.column(3).to_numpy() + moved[cluster])
            cluster, upper, _ = assign(v, centroids, half, cluster, upper, lower)
            np.add.at(total, cluster, v)
            n += np.bincount(cluster, minlength=k)
            # bounds are kept in 32 bits, once more rounded down
            small = np.maximum(np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), np.float32(0))
            none = pa.nulls(len(v), pa.list_(pa.int64()))
            bounds = pa.nulls(len(v), pa.list_(pa.float32())) if last else pa.ListArray.from_arrays(np.arange(0, len(v) * k + 1, k, dtype=np.int32), pa.array(small.reshape(-1)))
            distance = pa.array(squares(v, centroids[cluster])) if last else pa.nulls(len(v), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), bounds, distance, none, pa.nulls(len(v), pa.int64())], NAMES)
        held = np.flatnonzero(n)
        if len(held):
            e = len(held)
            sums = pa.ListArray.from_arrays(np.arange(0, e * dims + 1, dims, dtype=np.int32), pa.array(total[held].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.nulls(e, id_kind), pa.nulls(e, pa.list_(pa.int32())), pa.array(held.astype(np.int32)), pa.nulls(e, pa.float64()), pa.nulls(e, pa.list_(pa.float32())), pa.nulls(e, pa.int64()), sums, pa.array(n[held])], NAMES)

    return state.mapInArrow(run, STATE.format(id=id_type))


NAMES = ["vec_id", "v", "cluster", "upper", "lower", "distance", "total", "n"]


def means(sums: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of sum / count; k rows reach the driver."""
    k, dims = centroids.shape
    added = sums.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.array(*[F.sum(F.get("total", i).cast("decimal(38,0)")) for i in range(dims)]).alias("t"))
    out = centroids.copy()
    for r in added.collect():
        out[r.cluster] = [int(t) // int(r.n) for t in r.t]
    return out


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    spark = df.sparkSession
    id_type = df.schema[vec_id].dataType.simpleString()
    path = scratch(spark, "vectors")
    whole_vectors(df, vec_id, embedding, dims, scale).write.parquet(path)
    vectors = spark.read.parquet(path)
    centroids = start_rows(vectors, k, salt)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    state, moved = vectors.select("vec_id", "v"), None
    for at in range(rounds + 1):
        before, path = path, scratch(spark, "bounds")
        one_round(state, centroids, moved, id_type, at == rounds).write.parquet(path)
        remove(spark, before)
        state = spark.read.parquet(path)
        if at < rounds:
            new = means(state.where("total IS NOT NULL").select("cluster", "total", "n"), centroids)
            moved = up(np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)))
            moved[(new == centroids).all(1)] = 0.0
            centroids, state = new, state.where("total IS NULL")
    done = state.where("total IS NULL").select("vec_id", "cluster", "distance")
    by_cluster = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    told = by_cluster.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").crossJoin(F.broadcast(done.agg(F.sum("distance").alias("inertia"))))
    return done.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every embedding."""
    from docforge.llm.common import table

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    nearest = """a{i} AS MATERIALIZED (SELECT id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM
      (SELECT x.id, x.v, m.c, list_sum(list_transform(list_zip(x.v, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, m{i} m) GROUP BY id, v)"""
    moved = """s{i} AS (SELECT c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) r(j) GROUP BY c, j),
    f{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY c),
    m{n} AS MATERIALIZED (SELECT m.c, coalesce(f.m, m.m) AS m FROM m{i} m LEFT JOIN f{i} f ON f.c = m.c)"""
    steps = ",\n    ".join(f"{nearest.format(i=i)},\n    {moved.format(i=i, n=i + 1)}" for i in range(ROUNDS))
    return f"""WITH x AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    o AS (SELECT v, row_number() OVER (ORDER BY sha256('{SALT}' || CAST(id AS VARCHAR))) - 1 AS c FROM x),
    m0 AS MATERIALIZED (SELECT CAST(c AS INT) AS c, v AS m FROM o WHERE c < {K}),
    {steps},
    {nearest.format(i=ROUNDS)}
    SELECT a.id AS vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(m.m, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN m{ROUNDS} m ON m.c = a.c"""


#: Sums and distances are whole numbers, so the rounds in SQL are the same ones.
SQL = _sql()
