"""Document quality by a sparse ensemble of rules.

Statistics of a text are Spark columns. Shallow trees are grown on labelled rows, each on other rows and other statistics;
every path from a root to a node is a rule, a conjunction of thresholds. A logistic model with an L1 penalty weights the
rules, most of them by zero, and what is left becomes one Spark column again: the score of all texts is made in the JVM in
one pass, without a shuffle.

Fitted are at most SAMPLE labelled documents (a documented bound: those of least hash of doc_id, so that neither the order
of rows nor what is held out matters); all texts are scored, and whole. Labels come from rows whose crc32(doc_id) mod 3
isn't 1; doc_id, lang, source and labels are nothing that a rule can ask for.

Defined results: a null text is an empty one, whose statistics are all 0; it has a score as any other. Null or other
qualities than 0 and 1 teach nothing; a document with several labels has their mean, and 0.5 teaches nothing. Several rows
of a doc_id are scored each by its text, and teach with the least of their statistics. Without labels every score is 0.5,
with labels of one kind all are near it. A null doc_id isn't held out and has no label. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import fresh

FOLDS, HELD_OUT = 3, 1
#: Labelled documents that are fitted at most; trees; their depth; thresholds of a statistic; rows of a node; penalty.
SAMPLE, TREES, DEPTH, CUTS, LEAST, PENALTY, SEED = 16_384, 24, 3, 16, 8, 2e-3, 12


def held_out(doc_id: Column, folds: int = FOLDS, out: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == out, F.lit(False))


#: What a rule may ask of a text.
STATISTICS = ["chars", "words", "word_chars", "line_words", "short_lines", "other_lines", "other_words", "marks", "mark_runs", "capitals", "bare_words", "digits", "ends", "commas", "shouts", "bars", "links", "braces"]


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is made once a row: the optimiser doesn't copy what stands below an explode into its users."""
    return df.withColumn(name, F.explode(F.array(value)))


def with_statistics(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with an array of doubles in the order of STATISTICS, 0 where there is nothing to count. The text is cut once,
    and each pattern is counted once."""
    parts, counts = fresh(docs, "_parts"), fresh(docs, "_counts")
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x) != "")
    cut = settled(docs, parts, F.struct(whole.alias("t"), lines.alias("lines"), F.filter(F.split(whole, r"\s+"), lambda x: x != "").alias("words")))
    t = F.col(f"{parts}.t")
    n = lambda p: F.regexp_count(t, F.lit(p))
    of = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    made = {
        "chars": F.length(t), "words": F.size(f"{parts}.words"), "other_words": F.size(F.array_distinct(f"{parts}.words")),
        "lines": F.size(f"{parts}.lines"), "other_lines": F.size(F.array_distinct(f"{parts}.lines")), "short_lines": F.size(F.filter(f"{parts}.lines", lambda x: F.length(x) < 30)),
        "marks": n(r"[^\p{L}\p{N}\s.,;:'\"!?()\-]"), "mark_runs": n(r"[^\p{L}\p{N}\s]{2,}"), "capitals": n(r"\p{Lu}{2,}"), "bare_words": F.size(F.filter(f"{parts}.words", lambda w: ~w.rlike(r"\p{L}"))),
        "digits": n(r"\p{N}"), "ends": n(r"[.!?](?=\s|$)"), "commas": of(","), "shouts": of("!"), "bars": of("|"), "links": of("://"), "braces": n(r"[{}<>\[\]=_/\\]"),
    }
    counted = settled(cut, counts, F.struct(*[c.cast("double").alias(k) for k, c in made.items()])).drop(parts)
    v = lambda k: F.col(f"{counts}.{k}")
    share = lambda a, b: F.when(v(b) > 0, v(a) / v(b)).otherwise(0.0)
    over = {"word_chars": ("chars", "words"), "line_words": ("words", "lines"), "short_lines": ("short_lines", "lines"), "other_lines": ("other_lines", "lines"), "marks": ("marks", "chars"), "digits": ("digits", "chars"), "braces": ("braces", "chars")}
    of_words = lambda k: over.get(k, (k, "words"))
    stats = F.array(*[v(k) if k in ("chars", "words") else share(*of_words(k)) for k in STATISTICS])
    return settled(counted, name, stats).drop(counts)


@dataclass(frozen=True)
class Rule:
    """All of its conditions hold: (statistic, whether above, threshold)."""

    conditions: frozenset[tuple[str, bool, float]]

    def column(self, value: Callable[[str], Column]) -> Column:
        out = F.lit(True)
        for name, above, cut in sorted(self.conditions):
            out = out & ((value(name) > cut) if above else (value(name) <= cut))
        return out

    def holds(self, names: list[str], rows: np.ndarray) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for name, above, cut in self.conditions:
            x = rows[:, names.index(name)]
            out &= (x > cut) if above else (x <= cut)
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, value: Callable[[str], Column]) -> Column:
        """Probability of label 1, as one expression of statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(value), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def scores(self, names: list[str], rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(names, rows) for r, w in self.rules), np.zeros(len(rows))))))


def grow(above: np.ndarray, columns: list[tuple[str, float]], y: np.ndarray, rows: np.ndarray, usable: np.ndarray, path: frozenset, depth: int, least: int, out: set[Rule]) -> None:
    """Adds the rules of the nodes below one, which holds ``rows``; splits by the largest fall of Gini impurity."""
    if not depth or len(rows) < 2 * least:
        return
    ones, n = float(y[rows].sum()), len(rows)
    if ones in (0.0, float(n)):
        return
    right = above[np.ix_(rows, usable)].astype(np.float32)
    nr, pr = right.sum(0), right.T @ y[rows].astype(np.float32)
    nl, pl = n - nr, ones - pr
    fits = (nr >= least) & (nl >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = np.where(fits, pr * pr / nr + (nr - pr) ** 2 / nr + pl * pl / nl + (nl - pl) ** 2 / nl, -1)
    at = int(np.argmax(purity))
    if purity[at] <= (ones * ones + (n - ones) ** 2) / n + 1e-6 * n:
        return
    name, cut = columns[usable[at]]
    hit = above[rows, usable[at]]
    for side, mine in ((True, rows[hit]), (False, rows[~hit])):
        longer = path | {(name, side, cut)}
        out.add(Rule(longer))
        grow(above, columns, y, mine, usable, longer, depth - 1, least, out)


def simplified(rule: Rule) -> Rule:
    """The tightest threshold of each statistic and side."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, cut in rule.conditions:
        old = tight.get((name, above))
        tight[(name, above)] = cut if old is None else (max if above else min)(old, cut)
    return Rule(frozenset((n, a, c) for (n, a), c in tight.items()))


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weights) of a logistic model with an L1 penalty on the weights, by accelerated proximal gradients."""
    n, k = x.shape
    full = np.concatenate([np.ones((n, 1), np.float32), x.astype(np.float32)], 1)
    v = np.ones(k + 1, np.float32)
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(full @ v) ** 2 * 1.05)
    w = z = np.zeros(k + 1, np.float64)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(full @ z.astype(np.float32)).astype(np.float64)))
        new = z - step * (full.T @ (p - y).astype(np.float32)).astype(np.float64) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit_rows(names: list[str], rows: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, cuts: int = CUTS, least: int = LEAST, penalty: float = PENALTY, seed: int = SEED) -> Ensemble:
    """Rules of trees, weighted. The rows' order must not depend on chance; the same rows give the same ensemble."""
    n = len(y)
    if not n:
        return Ensemble(0.0, ())
    share = (float(y.sum()) + 1) / (n + 2)
    if not 0 < y.sum() < n:
        return Ensemble(float(np.log(share / (1 - share))) if n else 0.0, ())
    columns, made = [], []
    for k, name in enumerate(names):
        values = np.unique(rows[:, k])
        if len(values) > 1:
            edges = np.unique(np.concatenate([np.quantile(rows[:, k], np.arange(1, cuts) / cuts), np.quantile(values, np.arange(1, cuts) / cuts)]))
            for cut in edges[(edges >= values[0]) & (edges < values[-1])].tolist():
                columns.append((name, cut))
                made.append(rows[:, k] > cut)
    if not columns:
        return Ensemble(float(np.log(share / (1 - share))), ())
    above, owner = np.stack(made, 1), np.asarray([names.index(c[0]) for c in columns])
    rng, rules = np.random.default_rng(seed), set()
    for _ in range(trees):
        some = rng.choice(len(names), max(2, len(names) // 2), replace=False)
        usable = np.flatnonzero(np.isin(owner, some))
        mine = np.sort(rng.choice(n, max(1, n * 2 // 3), replace=False))
        if len(usable):
            grow(above, columns, y, mine, usable, frozenset(), depth, least, rules)
    ordered = sorted({simplified(r) for r in rules}, key=lambda r: sorted(r.conditions))
    held, seen = [], set()
    for r in ordered:  # rules that hold of the same rows are one
        mark = r.holds(names, rows)
        if 0 < mark.sum() < n and (key := mark.tobytes()) not in seen:
            seen.add(key)
            held.append((r, mark))
    if not held:
        return Ensemble(float(np.log(share / (1 - share))), ())
    bias, weights = lasso(np.stack([m for _, m in held], 1), y, penalty)
    return Ensemble(bias, tuple((r, float(w)) for (r, _), w in zip(held, weights) if abs(w) > 1e-3))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, folds: int = FOLDS, out: int = HELD_OUT) -> DataFrame:
    """(doc_id, y, s) of the labelled documents that are fitted, ``most`` at most, s with their statistics. What is chosen of
    labels bounds the broadcast and what reaches the driver."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, out))
    mean = known.select(F.col("doc_id").cast("string").alias("id"), "quality").groupBy("id").agg(F.avg("quality").alias("q")).where("q <> 0.5")
    chosen = mean.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), "text").join(F.broadcast(chosen), "id")
    return with_statistics(texts, "text", "s").groupBy("id", "q").agg(F.min("s").alias("s")).select("id", (F.col("q") > 0.5).alias("y"), "s")


def fit(docs: DataFrame, labels: DataFrame, **more) -> Ensemble:
    got = sorted(training_rows(docs, labels, **more).collect(), key=lambda r: r.id)
    return fit_rows(STATISTICS, np.asarray([r.s for r in got], np.float64).reshape(len(got), len(STATISTICS)), np.asarray([r.y for r in got], np.float64))


def scored(docs: DataFrame, model: Ensemble, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text; every rule reads the same statistics."""
    held = fresh(docs, "_statistics")
    return with_statistics(docs, text, held).withColumn(name, model.score(lambda k: F.get(held, STATISTICS.index(k)))).drop(held)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document."""
    from docforge.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
