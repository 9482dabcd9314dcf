"""Scans over parts of large groups: equal to plain windows and folds, however many parts there are."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docforge.operators import scan as S
from docforge.operators import sequence


@pytest.fixture
def parts(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", was)


def wide(spark, n, groups=3):
    """Rows of a large text, in no order; group 0 holds most of them, and one group's name is null."""
    g = F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % groups)
    return spark.range(0, n, 1, 16).select(F.nullif(g, F.lit(groups - 1)).alias("g"), F.xxhash64("id").alias("at"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("text"))


@pytest.mark.parametrize("n", [2, 8, 64])
def test_large_groups_of_wide_rows_are_numbered(spark, parts, n):
    parts(n)
    rows = wide(spark, 200_000)
    assert S.large_groups(rows, ["g"]) is not None
    want = F.row_number().over(Window.partitionBy("g").orderBy("at"))
    made = sequence.numbered(rows, ["g"], ["at"])
    assert made.count() == 200_000
    assert made.withColumn("want", want).where("n <> want OR n IS NULL").count() == 0
    assert made.agg(F.sum(F.length("text"))).first()[0] == 200_000 * 256


def test_parts_are_even(spark, parts):
    parts(8)
    rows = spark.range(0, 100_000, 1, 8).select(F.lit("k").alias("g"), F.xxhash64("id").alias("at"))
    dealt, part = S.in_parts(rows, ["g", "at"])
    sizes = [r[0] for r in dealt.groupBy(part).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 100_000 / 8
    plan = sequence.numbered(rows, ["g"], ["at"])._jdf.queryExecution().toString()
    assert "Window" in plan and plan.count("rangepartitioning") == 0


@pytest.mark.parametrize("n", [2, 7])
def test_running_values_equal_windows(spark, parts, n):
    parts(n)
    rows = wide(spark, 20_000).withColumn("v", F.when(F.col("at") % 5 == 0, F.pmod("at", F.lit(1000)))).withColumn("b", F.col("at") % 997 == 0)
    w = Window.partitionBy("g").orderBy("at")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    running = {"s": S.Running(F.col("v")), "m": S.Running(F.col("b"), "max"), "l": S.Running(F.col("v"), "last"), "p": S.Running(F.col("v"), "last", True), "i": S.Running(F.col("v"), "min"), "q": S.Running(F.col("v"), "sum", True)}
    made = S.scan(rows, ["g"], ["at"], running, 0)
    want = {"s": F.sum("v").over(upto), "m": F.max("b").over(upto), "l": F.last("v", True).over(upto), "p": F.last("v", True).over(before), "i": F.min("v").over(upto), "q": F.sum("v").over(before)}
    wrong = made.withColumns({f"w_{k}": c for k, c in want.items()}).where(" OR ".join(f"NOT ({k} <=> w_{k})" for k in want))
    assert wrong.count() == 0
    one = S.scan(rows, [], ["at"], {"n": S.Running(F.lit(1))}, 0)
    assert one.agg(F.count_distinct("n"), F.max("n")).first() == (20_000, 20_000)


def test_one_key_sequence_operators(spark, parts):
    """Latches, headers, runs and fences of one hot key are those of small groups."""
    rng = random.Random(3)
    kinds = [rng.choice(["a", "a", "b", None]) for _ in range(30_000)]
    rows = spark.createDataFrame([("x", i, k, "```" if rng.random() < 0.01 else "t") for i, k in enumerate(kinds)], "d string, i int, k string, line string").repartition(5, "i")
    parts(6)
    assert S.large_groups(rows, ["d"]) is not None
    got = [r.run for r in sequence.islands(rows, ["d"], "i", "k").orderBy("i").collect()]
    want, n, last = [], 0, object()
    for k in kinds:
        n, last = n + (k != last), k
        want.append(n)
    assert got == want
    assert sequence.latch(rows, ["d"], ["i"], F.col("i") == 777).where("latched <> (i >= 777)").count() == 0
    fences = sequence.outside_fences(rows, ["d"], "i").agg(F.max("fences")).first()[0]
    assert fences == rows.where("line = '```'").agg(F.max("i"), F.count("*")).first()[1] - (1 if rows.orderBy(F.desc("i")).first().line == "```" else 0)
    merged = sequence.merge_runs(rows, ["d"], "i", "k", "line", ["a"])
    assert merged.agg(F.sum("n")).first()[0] == 30_000 and merged.where("tag = 'b' AND n > 1").count() == 0


@pytest.mark.parametrize("n,most", [(7, 100), (3, 10**9)])
def test_packing_over_parts_equals_the_fold(spark, parts, n, most):
    parts(n)
    rng = random.Random(n + most)
    rows = [("hot" if i % 10 else "cold", i, rng.choice([0, 1, 5, 30, 200]), rng.randrange(9)) for i in range(6_000)]
    df = spark.createDataFrame(rows, "g string, i int, s int, t int").repartition(4, "i")
    for other in (None, ("t", most // 10))[most > 100 :]:
        got = sequence.pack(df, ["g"], "i", "s", most, other, least=0)
        want = sequence.pack(df, ["g"], "i", "s", most, other, least=10**9)
        assert got.count() == 6_000 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("apart", [45])
def test_spacing_over_parts_equals_the_fold(spark, parts, apart):
    parts(5)
    rng = random.Random(apart)
    df = spark.createDataFrame([("hot" if i % 7 else None, rng.randrange(60_000)) for i in range(20_000)], "g string, at int").repartition(4, "at").distinct().na.fill("cold")
    got, want = sequence.spaced(df, ["g"], "at", apart, least=0), sequence.spaced(df, ["g"], "at", apart, least=10**9)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("least", [0, 10**9])
def test_machines_run_over_parts(spark, parts, least):
    """A lock that only its key opens, and a toggle: states of a hot group and of small ones."""
    parts(6)
    rng = random.Random(5)
    table = [[1, 0, 2], [1, 2, 1], [0, 1, 2]]
    rows = [(None if i % 9 == 0 else i % 3 and "hot", i, rng.choice([0, 1, 2, None])) for i in range(9_000)]
    rows = [(g if g != 0 else "cold", i, x) for g, i, x in rows]
    df = spark.createDataFrame(rows, "g string, i int, x int").repartition(4, "i")
    made = {(r.g, r.i): r.state for r in S.automaton(df, ["g"], ["i"], F.col("x"), table, least=least).collect()}
    now = {}
    for g, i, x in rows:
        now[g] = now.get(g, 0) if x is None else table[now.get(g, 0)][x]
        assert made[(g, i)] == now[g]
    assert len(made) == 9_000


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "g string, _g int, _part int, _sum0 int, at int")
    assert sequence.numbered(empty, ["g"], ["at"]).count() == 0
    rows = spark.range(50).select(F.lit("a").alias("g"), F.lit(1).alias("_g"), F.lit(2).alias("_part"), F.lit(3).alias("_sum0"), F.lit(4).alias("_edges"), F.col("id").alias("at"))
    made = S.scan(rows, ["g"], ["at"], {"n": S.Running(F.lit(1))}, 0)
    assert made.columns == [*rows.columns, "n"] and made.where("n <> at + 1 OR _g <> 1 OR _part <> 2 OR _sum0 <> 3").count() == 0
    assert S.automaton(rows, ["g"], ["at"], F.lit(0), [[1], [0]], least=0).where("state <> (at + 1) % 2").count() == 0
