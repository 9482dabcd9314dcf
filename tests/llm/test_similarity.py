"""op1, op4 and op6 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from docforge.llm import decontaminate, graph, simhash_dedup, vector_dedup

from tests.llm.fixtures import AWKWARD, documents, prose


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_print(text):
    words = [w for w in re.split(b"[\x20\x09-\x0d]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    if not words:
        return 0
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in ([b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = prose(i, rng.randint(30, 200)).split(" ")
        for k in range(rng.choice([1, 1, 1, 3, 6])):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(copy), "en"))
    return rows + [r for r in AWKWARD if r[0] != 6]


@pytest.mark.parametrize("few", [1, 32])
def test_simhash_components(spark, monkeypatch, few):
    """few = 1 sends every shared key through the bounded parts instead of the join."""
    monkeypatch.setattr(simhash_dedup.near_links, "__defaults__", (simhash_dedup.RADIUS, few))
    rows = corpus()
    prints = [plain_print(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    want = sorted(str((rows[i][0], f"{prints[i]:016x}", least.get(root[i]))) for i in root)
    df = documents(spark, rows)
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in simhash_dedup.near_duplicates(df).collect()) == want
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(least.get(r)) for r in set(root.values()))
    assert {r._fp for r in kept.collect()} == {"y"}


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_masks_miss_no_pair(blocks):
    rng = random.Random(blocks)
    own = [m & (1 << 64) - 1 for m in simhash_dedup.masks(blocks)]
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & flips == 0 for m in own)


def test_more_blocks_for_more_rows():
    n = [simhash_dedup.blocks_for(10**k) for k in range(1, 12)]
    assert n == sorted(n) and n[0] == 5 and n[-1] > 8


def test_dense_group_gives_few_links(spark):
    rng = random.Random(1)
    center = rng.getrandbits(64)
    points = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    fps = [p - (1 << 64) if p >> 63 else p for p in points]
    prints = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = simhash_dedup.near_links(prints, len(fps)).distinct().collect()
    assert len(links) < 40 * len(fps)
    assert len(set(roots(fps, [(r.a, r.b) for r in links]).values())) == 1


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    links = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 80)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)], "none": []}[shape]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    own = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: r for n, r in roots(own, [x for x in links if x[0] != x[1]]).items()}


def vectors():
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for _ in range(40):
        base = rng.standard_normal(16)
        for k in range(rng.choice([1, 1, 2, 5])):
            v = base / np.linalg.norm(base) + (0.02 if k else 0) * rng.standard_normal(16)
            for _ in range(1 + int(rng.random() < 0.2)):
                rows.append((n, [float(np.float32(x)) for x in v * rng.choice([1.0, 3.0])], int(n % 2)))
                n += 1
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [float("inf")] + [0.0] * 15, 1), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:8], 0), (n + 6, [], 0), (n + 7, [None] + [1.0] * 15, 0), (None, rows[0][1], 0), (n + 8, [1e-30] * 16, 0), (n + 9, [1e-30] * 16, 0), (n + 10, [0.0] * 15 + [1.0], 1), (n + 11, [-0.0] * 15 + [1.0], 1)]
    return rows + odd + [rows[0], rows[0]]


@pytest.mark.parametrize("block", [2048, 2])
def test_vectors(spark, block):
    """block = 2 deals every bucket over several parts."""
    rows = vectors()
    usable = [v is not None and g is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v, g in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.asarray(rows[k][1]) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links.append((i, j))
    root, n = roots(range(len(rows)), links), Counter(x for e in links for x in e)
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    want = sorted(str((rows[i][0], n[i], least.get(root[i]), rows[i][0] is not None and rows[i][0] == least.get(root[i]))) for i in root)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, label int, v string, cid string")
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in vector_dedup.near_vectors(df, block=block).collect()) == want


def test_recall_at_the_threshold():
    """Pairs just above the threshold share a bucket of some table."""
    rng = np.random.default_rng(1)
    n = 2000
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    d = rng.standard_normal((n, 64))
    d -= (d * a).sum(1)[:, None] * a
    d /= np.linalg.norm(d, axis=1)[:, None]
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * d
    t = vector_dedup.tables_for(0.98)
    h = lambda x: vector_dedup.hashes(x, t, vector_dedup.PROJECTIONS, vector_dedup.WIDTH, vector_dedup.SEED)
    assert (h(a) == h(b)).any(1).mean() >= 0.995


def test_no_vectors(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    assert simhash_dedup.near_duplicates(documents(spark, AWKWARD).where("1 = 0")).count() == 0


ITEMS = [(1, prose(901, 30)), (2, prose(902, 60)), (3, "Too short"), (4, None), (5, ""), (6, prose(903, 6)), (7, prose(901, 30)), (None, prose(904, 20)), (8, " ".join(["again"] * 12))]


def leaky():
    words = {i: t.split() for i, t in ITEMS if t}
    edited = list(words[2])
    edited[30] = "edited"
    far = [w if i % 4 else "far" for i, w in enumerate(words[2])]
    texts = [
        prose(1, 300), f"{prose(2, 100)} {ITEMS[0][1].upper()} {prose(3, 100)}", " ".join(edited), " ".join(far), ", ".join(words[2]) + "!", "too SHORT!", f"too short {prose(4, 20)}",
        " ".join(words[1][:28]), " ".join(words[1][:12]), f"{ITEMS[5][1]} {ITEMS[5][1]}", " ".join(["again"] * 500), ITEMS[7][1], f"{prose(5, 50_000)} {ITEMS[1][1]}", None, "", "x" * 300_000,
    ]
    return [(100 + i, t, "en") for i, t in enumerate(texts)]


def plain_leaks(text):
    words = decontaminate.words_of(text or "")
    own = decontaminate.shingles(words)
    present = set(own)
    out = {}
    for k, (_, item) in enumerate(ITEMS):
        parts = decontaminate.shingles(decontaminate.words_of(item or ""))
        weight = sum(map(len, parts))
        counts = Counter(parts)
        if not parts or sum(len(s) * n for s, n in counts.items() if s in present) < 0.8 * weight:
            continue
        best = 0.0
        for at in range(max(1, len(own) - len(parts) + 1)):
            held = Counter(own[at : at + len(parts)])
            best = max(best, sum(min(n, held[s]) * len(s) for s, n in counts.items()) / weight)
        if best >= 0.8:
            out[k] = best
    return out


def test_leaks(spark):
    docs = leaky()
    want = sorted(str((i, ITEMS[k][0], round(v, 9))) for i, t, _ in docs for k, v in plain_leaks(t).items())
    assert len(want) >= 10
    bench = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id bigint, text string, doc_id string")
    df = documents(spark, docs)
    for slice_bytes in (decontaminate.SLICE_BYTES, 300):
        got = decontaminate.find_leaks(df, bench, slice_bytes=slice_bytes)
        assert sorted(str((r.doc_id, r.item_id, round(r.similarity, 9))) for r in got.collect()) == want
    clean = decontaminate.drop_leaks(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t, _ in docs if not plain_leaks(t)}


@pytest.mark.parametrize("long", [0, 64, 150, 300])
def test_a_long_token_inside_hides_no_leak(long):
    """An item copied whole with one token in its middle, found as by brute force over all windows."""
    rng, missed, leaks = random.Random(long), 0, 0
    for _ in range(60):
        item = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60)]
        text = f"{prose(1, 40)} {' '.join(item[:30])} {'k' * long} {' '.join(item[30:])} {prose(2, 40)}"
        own, parts = (decontaminate.shingles(decontaminate.words_of(t)) for t in (text, " ".join(item)))
        exact = [sum(len(s) * n for s, n in (Counter(own[a : a + len(parts)]) & Counter(parts)).items()) / sum(map(len, parts)) for a in range(len(own) - len(parts) + 1)]
        found = decontaminate.Benchmark([(1, " ".join(item))]).leaks(text)
        leaks += max(exact) >= decontaminate.THRESHOLD
        missed += found != ([(0, max(exact), exact.index(max(exact)))] if max(exact) >= decontaminate.THRESHOLD else [])
    assert leaks and not missed


@pytest.mark.parametrize("item", ["以下哪一项是正确的答案，请选择最合适的选项并说明理由。" * 3, "ข้อใดต่อไปนี้เป็นคำตอบที่ถูกต้องที่สุด", "次のうち正しいものはどれですか「一つ」選びなさい", "l’eau «bout» à quelle température exactement"])
def test_items_of_unspaced_scripts_and_other_punctuation(item):
    around = "前の文章がここに続いている" if ord(item[0]) > 0x3000 else "ข้อความอื่น" if ord(item[0]) > 0xE00 else "… d’autres mots avant —"
    own = decontaminate.Benchmark([(1, item)])
    assert [x[:2] for x in own.leaks(f"{around}{item}{around}")] == [(0, 1.0)]
    assert own.leaks(around) == []


@pytest.mark.parametrize("filed", [0, 1 << 16, decontaminate.INDEX_BYTES])
def test_multi_index_finds_all_within_radius(monkeypatch, filed):
    """Flips of RADIUS bits in any one of the fingerprints, by the index and by comparing whole fingerprints."""
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", filed)
    own = decontaminate.Benchmark([(i, prose(i, 20)) for i in range(50)])
    size = int(own.size[0])
    rng = random.Random(2)
    for j in np.flatnonzero(own.size == size).tolist():
        k = rng.randrange(decontaminate.PRINTS)
        window = ~own.prints[j]
        window[k] = own.prints[j, k] ^ np.uint64(sum(1 << b for b in rng.sample(range(64), decontaminate.RADIUS)))
        assert j in own.near(window[None, :], size)[1]


def test_multi_index_equals_all_comparisons_and_is_quicker():
    import time

    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 64, (20_000, decontaminate.PRINTS), dtype=np.uint64)
    windows = prints[:512] ^ (np.uint64(1) << rng.integers(0, 64, (512, decontaminate.PRINTS), dtype=np.uint64))
    index = decontaminate.MultiIndex(prints)
    assert index.lists
    began = time.process_time()
    w, j = index.near(windows)
    took = time.process_time() - began
    began = time.process_time()
    want = [np.flatnonzero((np.bitwise_count(x ^ prints) <= decontaminate.RADIUS).any(1)) for x in windows]
    direct = time.process_time() - began
    assert sorted(zip(w.tolist(), j.tolist())) == [(i, k) for i, x in enumerate(want) for k in x.tolist()]
    assert took < direct


@pytest.mark.parametrize(("words", "tokens"), [(9, 1), (12, 1), (60, 1), (300, 1), (60, 200)])
def test_recall_at_the_threshold_of_fingerprints(words, tokens):
    """Items damaged until they are barely alike enough, some with tokens of very different lengths: none is missed."""
    rng, missed, leaks = random.Random(words), 0, 0
    for trial in range(250):
        item = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9) if rng.random() < 0.9 else rng.randint(1, tokens) + 8)) for _ in range(words)]
        parts = Counter(decontaminate.shingles(decontaminate.words_of(" ".join(item))))
        copy, held = list(item), 1.0
        for k in rng.sample(range(words), words):
            changed = [*copy[:k], "zz" + "y" * rng.choice([1, 5, 300]), *copy[k + 1 :]]
            own = Counter(decontaminate.shingles(decontaminate.words_of(" ".join(changed))))
            now = sum(min(n, own[s]) * len(s) for s, n in parts.items()) / sum(len(s) * n for s, n in parts.items())
            if now < decontaminate.THRESHOLD:
                break
            copy, held = changed, now
        found = decontaminate.Benchmark([(1, " ".join(item)), (2, prose(trial, 60))]).leaks(f"{prose(1, 30)} {' '.join(copy)} {prose(2, 30)}")
        leaks += 1
        missed += 0 not in [j for j, *_ in found]
    assert leaks == 250 and missed == 0


def test_rolling_hash_in_pieces(monkeypatch):
    words = [bytes(random.Random(i).choices(b"abc", k=1 + i % 9)) for i in range(400)]
    whole = decontaminate.rolling(words)
    monkeypatch.setattr(decontaminate, "PIECE", 100)
    assert (decontaminate.rolling(words) == whole).all()


def test_no_documents_no_items(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    df = documents(spark, leaky())
    assert decontaminate.find_leaks(df.where("1 = 0"), bench).count() == 0
    assert decontaminate.find_leaks(df, bench.where("1 = 0")).count() == 0


@pytest.mark.parametrize("counted", [None, "times"])
def test_spread_join_is_a_join(spark, monkeypatch, counted):
    """Hot keys go by the broadcast, the others by the shuffle, none both ways."""
    monkeypatch.setattr(graph, "BLOCK", 10)
    many = spark.createDataFrame([(k, i) for k in range(40) for i in range(1 + 25 * (k % 3 == 0))], "k bigint, i bigint")
    one = many.where("k % 7 <> 0").groupBy("k").count().withColumnRenamed("count", "times")
    got = graph.spread_join(many, one, ["k"], many.count(), counted, hot=100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, "k").collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_components_of_hubs(spark, monkeypatch):
    """Every node of over ten links is a hub: their links are joined by the broadcast."""
    monkeypatch.setattr(graph, "BLOCK", 10)
    links = [(1000 + h, h * 50 + i) for h in range(6) for i in range(50)] + [(1001, 1003), (7, 2000), (2000, 2001)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == roots({n for e in links for n in e}, links)


def test_words_against_a_plain_pattern():
    import unicodedata

    signs = "".join(re.escape(chr(i)) for i in range(128, 0x20000) if unicodedata.category(chr(i))[0] in "PZ")
    split = re.compile(f"([{decontaminate._UNSPACED}])|[{signs}]")
    rng = random.Random(9)
    points = [*range(32, 0x250), *range(0xE00, 0xF00), *range(0x2000, 0x2070), *range(0x3000, 0x3100), *range(0x4E00, 0x4E80), 0x1F600, 0x20001, 0xD7FF, 0xFFFD]
    for _ in range(800):
        t = "".join(chr(rng.choice(points)) for _ in range(rng.randint(0, 30)))
        plain = split.sub(lambda m: f" {m[1]} " if m[1] else " ", t.lower())
        assert decontaminate.words_of(t) == plain.encode("utf-8", "replace").translate(decontaminate._SPACE).split(), t
