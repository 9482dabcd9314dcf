"""Clustering, quality rules and the prefix trie against plain versions, and what they have to stand."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docforge.llm import centroids as C
from docforge.llm import prefix_trie as T
from docforge.llm import rule_quality as Q
from docforge.llm.queries import QUERIES

from .fixtures import AWKWARD, documents, prose, save

# ---- centroids


def plain_clusters(rows, k, rounds, scale=256, salt="2:"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept)
    cents = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, o in got if o == j) for j in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i, o, d, inertia[o], sum(inertia.values()), digest[o]) for i, d, o in got)


SCHEMA = "vec_id bigint, embedding array<double>, label int, v string, cluster string, `Total` string, lower string"


def clustered(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in C.cluster_vectors(df, **more).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_equal_a_plain_version(spark):
    rng = random.Random(1)
    # few values, so that many distances are equal; a third of all rows are copies of one vector
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(8)] if i % 3 else [0.25] * 8) for i in range(400)]
    assert clustered(spark, rows, k=12, dims=8) == plain_clusters(rows, 12, 5)


def test_few_odd_and_no_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(7, [0.1, -0.1]), (7, [0.1, -0.1]), (8, [3.0, 4.0]), (-9, [0.0, 0.0])]
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    assert clustered(spark, good + odd, k=40, dims=2) == plain_clusters(good, 40, 5)
    assert clustered(spark, odd, dims=2) == []
    nameless = spark.createDataFrame([(7, [0.1, -0.1]), (None, [9.0, 9.0])], "vec_id bigint, embedding array<double>")
    assert sorted(r.distance for r in C.cluster_vectors(nameless, k=2, dims=2).collect()) == [0, 0]
    with pytest.raises(Exception, match="a component is beyond"):
        clustered(spark, [(1, [1e30, 0.0])], dims=2)


def test_bounds_prune_and_never_change_a_result():
    rng = np.random.default_rng(4)
    v = rng.integers(-40, 40, (600, 6))
    cents = v[:25].copy()
    cluster, upper, lower = np.zeros(600, np.int64), np.full(600, np.inf), np.zeros((600, 25))
    least = []
    for _ in range(6):
        cluster, upper, computed = C.assign(v, cents, C.apart(cents), cluster, upper, lower)
        least.append(computed)
        d = ((v[:, None, :] - cents[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        true = np.sqrt(d.astype(np.float64))
        assert (upper >= true[np.arange(600), cluster]).all() and (lower <= true).all()
        new = np.stack([v[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else cents[j] for j in range(25)])
        moved = C.up(np.sqrt(((new - cents) ** 2).sum(1).astype(np.float64)))
        upper, lower, cents = C.up(upper + moved[cluster]), C.down(lower - moved), new
    assert least[-1] < 600 * 25 / 3


# ---- rules


def plain_statistics(text):
    t = text or ""
    words = [w for w in t.split() if w]
    return {"chars": len(t), "words": len(words), "other_words": len(set(words)) / len(words) if words else 0.0, "commas": t.count(",") / len(words) if words else 0.0, "bars": t.count("|") / len(words) if words else 0.0}


def test_statistics(spark):
    docs = documents(spark, [*AWKWARD, (9, "Ab | cd, Ab\n\nAb | cd, Ab\nxx $$$ 12 http://a.b {}!", "en")])
    rows = Q.with_statistics(docs, "text", "s").select("text", "s").collect()
    assert len(rows) == len(AWKWARD) + 1
    for r in rows:
        got = dict(zip(Q.STATISTICS, r.s))
        assert all(math.isfinite(x) for x in r.s)
        if "\x85" not in (r.text or ""):
            assert {k: pytest.approx(got[k]) for k in ("chars", "words", "other_words", "commas", "bars")} == plain_statistics(r.text)
    last = dict(zip(Q.STATISTICS, next(r.s for r in rows if r.text and r.text.startswith("Ab"))))
    assert last["other_lines"] == 2 / 3 and last["short_lines"] == 1 and last["digits"] > 0 and last["links"] > 0 and last["braces"] > 0


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """Prose is good; bars, marks and shouting are not. One document has copies, some ids have no label or an odd one."""
    rows, labels = [], []
    for i in range(600):
        t = prose(i, 60)
        bad = i % 4 == 0
        if bad:
            t = [t.replace(" ", " | "), t.upper().replace(" ", "!! "), t.replace(" ", "$$$ ")][i % 3]
        rows.append((i, t, "en"))
        labels.append((i, int(not bad), 0))
    rows += [(5000, None, None), (5001, "", None), (None, "text without an id", None), (3, prose(3, 60), "en"), (3, "| | |", "en")]
    labels += [(None, 0, 0), (10_000, 1, 0), (7, None, 0), (9, 5, 0), (11, 0, 0), (11, 1, 0)]
    docs = documents(spark, rows)
    return rows, docs, labels


def test_rules_find_what_labels_say_and_only_training_labels(spark, labelled, tmp_path):
    rows, docs, labels = labelled
    put = lambda name, ls: save(spark, tmp_path / name, documents=docs, labels=spark.createDataFrame(ls, "doc_id bigint, quality int, toxic int"))
    run = lambda home: QUERIES["op12_rule_quality"](spark, home)
    got = run(put("a", labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    assert all(r.held_out == out(r.doc_id) for r in got)
    good = dict((i, q) for i, q, _ in labels if i is not None and i < 600 and i not in (7, 9, 11, 3))
    held = [r for r in got if r.held_out and r.doc_id in good]
    assert len(held) > 100 and sum(r.predicted == good[r.doc_id] for r in held) >= 0.97 * len(held)
    flipped = [(i, 1 - q if out(i) and q in (0, 1) else q, t) for i, q, t in labels]
    key = lambda rs: sorted((str(r.doc_id), r.score) for r in rs)
    assert key(run(put("b", flipped)).collect()) == key(got)
    assert {r.score for r in run(put("c", [])).collect()} == {0.5}
    assert all(r.predicted == 1 for r in run(put("d", [(i, 1, 0) for i in range(600)])).collect())
    empty = save(spark, tmp_path / "e", documents=docs.limit(0), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert run(empty).collect() == []


def test_rules_as_columns_equal_rules_in_numpy(spark, labelled):
    _, docs, labels = labelled
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert 1 <= len(model.rules) < 200  # most are weighted by zero
    rows = Q.with_statistics(Q.scored(docs, model), "text", "s").select("score", "s").collect()
    want = model.scores(Q.STATISTICS, np.asarray([r.s for r in rows]))
    assert np.allclose([r.score for r in rows], want, atol=1e-12)
    plan = Q.scored(docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert Q.scored(docs, model).columns == [*docs.columns, "score"]


# ---- trie


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    seqs = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + own[c][h[c] :]) for c in own}
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    words = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)])
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        mine = kids.get(p, [])
        saved[p] = ((len(nodes[p]) - 1) * words(p[-1][1]) if p else 0) + sum(saved[k] for k in mine)
        leaves[p] = sum(leaves[k] for k in mine) or 1
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if seqs[c] == p).encode()).hexdigest())
        for p, m in nodes.items()
    )


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, id string, `Depth` int")
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in T.conversation_trie(df.repartition(5)).collect())


@pytest.mark.parametrize("parts,seed", [(1, 1), (5, 2), (40, 3)])
def test_trie_equals_a_plain_version(spark, parts, seed):
    """Few different turns, so that conversations branch everywhere, end inside others and repeat; ranges cut every path."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 900), 500):
        same = c % 3 == 0
        for turn in range(6 if same else rng.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, turn if rng.random() < 0.95 else rng.choice([None, 1]), rng.choice(["user", "assistant", None]) if not same else "user", "same words here" if same else rng.choice(["a", "b b", None, "c c\tc"])))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert trie(spark, rows) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_trie_of_odd_rows(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
    rows = [(5, None, None, None), (5, None, None, None), (0, 2, "user", "long " * 50_000), (0, 1, "user", "b"), (20, 1, "user", "b"), (21, 0, "user", "b")]
    rows += [(40, i, "user", f"turn {i}") for i in range(3000)]
    assert trie(spark, rows) == plain_trie(rows)


def test_blocks_of_ends(spark):
    """A third of all conversations end at one node: its ids are hashed in blocks, in order."""
    ids = random.Random(1).sample(range(10**6), 3000)
    rows = [(b"hot" if i % 3 else str(i).encode(), c) for i, c in enumerate(ids)]
    got = dict(tuple(r) for r in T.digests_of_ends(spark.createDataFrame(rows, "id binary, conv_id bigint"), block=64).select(F.decode("id", "utf-8"), "ends_sha256").collect())
    for name in {r[0] for r in rows}:
        assert got[name.decode()] == hashlib.sha256(",".join(str(c) for c in sorted(c for n, c in rows if n == name)).encode()).hexdigest()
