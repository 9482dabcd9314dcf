"""The exact join of like paragraph keys against all comparisons."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docforge.operators import dedup


def grams(text):
    key = "".join(c for c in text.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    return {key[i : i + 4] for i in range(len(key) - 3)} if len(key) >= 8 else None


def all_pairs(rows, similarity):
    least = {}
    for i, t in rows:
        key = "".join(c for c in (t or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
        if len(key) >= 8:
            least[key] = min(i, least.get(key, i))
    sets = {i: grams(k) for k, i in least.items()}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}


def texts(seed, n):
    rng = random.Random(seed)
    words = ["protein", "energy", "fluid", "salt", "rice", "lentil", "renal", "diet", "x1", "é", "zinc", "iron"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(3000))
    return [*enumerate(made), (n, None), (n + 1, ""), (n + 2, long), (n + 3, long[: len(long) * 3 // 4]), (n + 4, "aaaaaaaaaaaa"), (n + 5, "aaaaaaaa"), (n + 6, made[0])]


@pytest.mark.parametrize("similarity,part", [(0.6, 1024), (0.6, 16), (0.8, 64), (0.35, 64), (1.0, 64)])
def test_all_like_keys_are_found_once(spark, similarity, part):
    rows = texts(int(similarity * 100) + part, 400)
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("k", F.lit("clash")).withColumn("h", F.lit(1))
    got = [(r.a, r.b, r.similarity) for r in dedup.exact_pairs(df, "id", "t", similarity, part).collect()]
    want = all_pairs(rows, similarity)
    assert len(got) == len(want) and {(a, b): x for a, b, x in got} == pytest.approx(want)


@pytest.mark.parametrize("partitions", [2, 9])
def test_counts_of_like_keys(spark, partitions):
    rows = texts(5, 300) + [(1000 + i, f"the same long sentence about protein and energy, number {i % 70:03}") for i in range(140)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.id: (r.representative, r.n_like) for r in dedup.exact_groups(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", part=32).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pairs = all_pairs(rows, 0.6)
    assert len(got) == len(rows)
    for i, (representative, n) in got.items():
        assert n == sum(representative in p for p in pairs)
    assert got[1070] == (1000, got[1000][1]) and got[300] == (300, 0)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id bigint, t string")
    assert dedup.exact_pairs(empty, "id", "t").count() == 0 and dedup.exact_groups(empty, "id", "t").count() == 0


def test_a_pair_that_just_reaches_the_limit(spark):
    """Three of five grams in common: 0.6, and what is common is as frequent as can be."""
    rows = [(1, "abcdefgh"), (2, "abcdefxyz"), (3, "bcdefghz"), (4, "abcdefghij")] + [(10 + i, f"abcdef{i:04}zz{i:04}") for i in range(50)]
    got = {(r.a, r.b) for r in dedup.exact_pairs(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()}
    assert got == set(all_pairs(rows, 0.6))
