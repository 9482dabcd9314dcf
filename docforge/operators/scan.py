"""Running values of groups of any size: scans over parts of a group, completed by what its earlier parts hold.

A window with one key is one task. Here a group of most rows is cut into parts at edges that are data: a sample of its keys
gives them, they are written once, and a row's part is a function of the row and the edges alone. So every pass sees the
same parts, whatever is retried, and edges decide only how even the parts are, never a result. Each part is scanned by
itself; totals of parts, a row a part, are scanned in turn and broadcast to the rows. Rows travel once, as for a window.

Groups that are no larger than a task's share keep the plain window. ``order`` names columns; nulls come first. Rows equal
in all of them are in one part and take any order among themselves, as in a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.operators.columns import fresh
from docforge.operators.lineage import cut

#: Groups of no more rows than this are never cut, and keys that are sampled for each part.
LEAST, SAMPLED = 10_000, 64


@dataclass(frozen=True)
class Running:
    """What rows up to each one (or before it) come to. kind: sum, max, min or last (the last that isn't null)."""

    value: Column
    kind: str = "sum"
    before: bool = False

    def over(self, window) -> Column:
        made = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}[self.kind](self.value)
        return made.over(window.rowsBetween(Window.unboundedPreceding, -1 if self.before else Window.currentRow))

    def total(self, order: list[str]) -> Column:
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value)

    def carried(self, name: str, window) -> Column:
        made = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}[self.kind](F.col(name))
        return made.over(window.rowsBetween(Window.unboundedPreceding, -1))

    def joined(self, carry: Column, own: Column) -> Column:
        if self.kind == "sum":
            return F.when(carry.isNull(), own).otherwise(carry + F.coalesce(own, F.lit(0)))
        return F.coalesce(own, carry) if self.kind == "last" else (F.greatest if self.kind == "max" else F.least)(carry, own)


def partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same(left: str, right: str, names: list[str]) -> Column:
    """The named columns of two aliased sides agree, nulls too."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names], F.lit(True))


@dataclass(frozen=True)
class Large:
    """keys: (by, number) of large groups, fewer than there are shuffle partitions. rows: how many rows they have."""

    keys: DataFrame
    rows: int


def large_groups(rows: DataFrame, by: list[str], least: int = LEAST) -> Large | None:
    """The groups that hold more than a task's share of the rows and more than ``least``; None if there are none."""
    n = partitions(rows)
    held = fresh(rows, "_rows")
    counts = rows.groupBy(*by).agg(F.count("*").alias(held))
    total, most = counts.agg(F.sum(held), F.max(held)).first()
    bound = max(least, (total or 0) // n)
    if not most or most <= bound:
        return None
    keys = cut(counts.where(F.col(held) > bound).withColumn(fresh(counts, "_group"), F.monotonically_increasing_id()))
    return Large(keys.drop(held), keys.agg(F.sum(held)).first()[0])


def split_large(rows: DataFrame, by: list[str], large: Large) -> tuple[DataFrame, DataFrame, str]:
    """(rows of the other groups, rows of large groups, name of the latter's group number)."""
    g = fresh(rows, "_g")
    told = F.broadcast(large.keys.withColumnRenamed(large.keys.columns[-1], g))
    if not by:
        return rows.limit(0), rows.crossJoin(told), g
    match = same("r", "g", by)
    return rows.alias("r").join(told.alias("g"), match, "left_anti"), rows.alias("r").join(told.alias("g"), match).select("r.*", f"g.{g}"), g


def edges_of(rows: DataFrame, key: list[str], n: int, total: int) -> DataFrame:
    """One row, e: n - 1 keys at most that cut the sorted rows evenly, from SAMPLED keys a part; written, so that all passes
    read the same."""
    seen = rows.select(F.struct(*key).alias("k")).sample(min(1.0, SAMPLED * n / max(1, total)), 17)
    ordered = seen.agg(F.array_sort(F.collect_list("k")).alias("ks"))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(1, n - 1))), lambda i: F.get("ks", (i * F.size("ks") / n).cast("int")))
    return cut(ordered.select(F.array_sort(F.array_distinct(F.filter(at, lambda k: k.isNotNull()))).alias("e")))


def part_of(edges: Column, key: Column, n: int) -> Column:
    """How many edges aren't above the key: a binary search, as a fold over powers of two."""
    steps = [1 << b for b in reversed(range(max(1, n).bit_length()))]
    fits = lambda at, s: (at + s <= F.size(edges)) & (F.get(edges, at + s - 1) <= key)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when(F.coalesce(fits(at, s), F.lit(False)), s).otherwise(0))


def in_parts(rows: DataFrame, key: list[str], total: int | None = None) -> tuple[DataFrame, str]:
    """(rows with their part's number, its name): parts are ranges of the key, about as even as the sample. total: how many
    rows there are, if that is known."""
    n, part, e = partitions(rows), fresh(rows, "_part"), fresh(rows, "_edges")
    edges = edges_of(rows, key, n, rows.count() if total is None else total).withColumnRenamed("e", e)
    return rows.crossJoin(F.broadcast(edges)).withColumn(part, part_of(F.col(e), F.struct(*key), n)).drop(e), part


#: Scans look for large groups themselves, unless they are told.
ASK = object()


def scan(rows: DataFrame, by: list[str], order: list[str], running: dict[str, Running], least: int = LEAST, large: Large | None | object = ASK) -> DataFrame:
    """rows with the running values of their group. A column of one of the names is replaced. large: what large_groups has
    said of these rows or of a table that they were made of, for operators that scan several times."""
    window = Window.partitionBy(*by).orderBy(*order)
    plain = lambda df: df.withColumns({name: r.over(window) for name, r in running.items()})
    large = large_groups(rows, by, least) if large is ASK else large
    if large is None:
        return plain(rows)
    few, many, g = split_large(rows, by, large)
    dealt, part = in_parts(many, [g, *order], large.rows)
    made = dealt.withColumns({name: F.lit(None) for name in running})
    names = {name: fresh(made, f"_carry{k}") for k, name in enumerate(running)}
    totals = dealt.groupBy(g, part).agg(*[r.total(order).alias(names[name]) for name, r in running.items()])
    upto = Window.partitionBy(g).orderBy(part)
    carry = totals.select(g, part, *[r.carried(names[name], upto).alias(names[name]) for name, r in running.items()])
    inner = Window.partitionBy(part, g).orderBy(*order)
    made = dealt.repartitionById(partitions(rows), F.col(part)).withColumns({name: r.over(inner) for name, r in running.items()})
    both = made.join(F.broadcast(carry), [g, part])
    done = both.withColumns({name: r.joined(F.col(names[name]), F.col(name)) for name, r in running.items()})
    columns = plain(few).columns
    return plain(few).unionByName(done.select(*columns)) if by else done.select(*columns)


def _by_part(items: DataFrame, part: str, keys: list[str], run, schema: str) -> DataFrame:
    """run's output for each task's parts: batches come sorted by keys, a part never lies in two tasks."""
    return items.repartitionById(partitions(items), F.col(part)).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of each (group, part) in turn; its numbers are in memory, its rows aren't."""
    held: list[list[np.ndarray]] = []
    key = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        marks = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
        for a, b in zip([0, *marks], [*marks, batch.num_rows]):
            if a == b:
                continue
            now = (columns[0][a], columns[1][a])
            if key is not None and now != key:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held = []
            key = now
            held.append([c[a:b] for c in columns])
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, pos, exit): the first start outside its part that each row's chain comes to. Pointers double inside a part."""
    for g, _, pos, nxt in _stretches(batches):
        out = nxt.copy()
        while True:
            inside = np.flatnonzero(out < pos[0] + len(pos))
            if not len(inside):
                break
            out[inside] = out[out[inside] - pos[0]]
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(pos), pa.array(out)], ["g", "pos", "exit"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, pos): the starts of each part, from its entry on."""
    for g, _, pos, nxt, entered in _stretches(batches):
        starts = []
        for at in np.flatnonzero(entered):
            at = int(at) + int(pos[0])
            while at < pos[0] + len(pos):
                starts.append(at)
                at = int(nxt[at - pos[0]])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), g[0])), pa.array(np.asarray(starts, np.int64))], ["g", "pos"])


@dataclass(frozen=True)
class Reach:
    """A stretch that starts at a row ends before the first later row whose mark is past the row's limit (or at it, if
    ``at`` is set). Marks never fall along the order."""

    mark: Column
    limit: Column
    at: bool = False


def chain(rows: DataFrame, by: list[str], order: str, running: dict[str, Running], reaches: list[Reach]) -> DataFrame:
    """(by, order) of the rows that start a stretch, for groups of any size, over many tasks.

    The first row of a group starts one; each next start is the first row beyond the reach of the last, and at the latest
    that of the nearest of several reaches. Every row's next start is found by one scan over marks and limits in one order.
    Pointers then double, first inside parts and then over the few rows where chains leave their part, so that a group of
    any length takes log n joins; last, each part walks from where the chain enters it. order is unique in its group.
    running: columns that marks and limits are made of.
    """
    numbered = cut(scan(rows, by, [order], running | {"_pos": Running(F.lit(1).cast("bigint"))}, 0))
    keys = cut(numbered.groupBy(*by).agg(F.count("*")).select(*by, F.monotonically_increasing_id().alias("_g")))
    told = numbered.alias("r").join(F.broadcast(keys).alias("k"), same("r", "k", by)).select("r.*", "k._g")
    items = told.select("_g", "_pos", *by, order, *[F.struct(r.mark.alias("m"), r.limit.alias("l")).alias(f"_r{k}") for k, r in enumerate(reaches)])
    far = F.lit((1 << 62) - 1)
    nexts = items.select("_g", "_pos")
    for k, r in enumerate(reaches):
        mine = items.select("_g", "_pos", f"_r{k}.m", f"_r{k}.l")
        # from the largest mark down: the last row seen before a limit is the first one past it
        events = mine.select("_g", (-F.col("m")).alias("v"), F.lit(0 if r.at else 1).alias("kind"), (-F.col("_pos")).alias("p"), F.col("_pos").alias("row")).unionByName(mine.select("_g", (-F.col("l")).alias("v"), F.lit(1 if r.at else 0).alias("kind"), (-F.col("_pos")).alias("p"), F.lit(None).cast("bigint").alias("row")))
        found = scan(events, ["_g"], ["v", "kind", "p"], {"next": Running(F.col("row"), "last")}, 0)
        nexts = nexts.join(found.where("row IS NULL").select("_g", (-F.col("p")).alias("_pos"), F.col("next").alias(f"_n{k}")), ["_g", "_pos"])
    step = F.least(*[F.coalesce(f"_n{k}", far) for k in range(len(reaches))], far)
    nexts = cut(nexts.select("_g", "_pos", F.greatest(step, F.col("_pos") + 1).alias("_next")))
    dealt, part = in_parts(nexts, ["_g", "_pos"])
    dealt = cut(dealt.select("_g", F.col(part).alias("part"), F.col("_pos").alias("pos"), F.col("_next").alias("nxt")))
    exits = cut(_by_part(dealt, "part", ["_g", "part", "pos"], _exits, "g bigint, pos bigint, exit bigint"))
    targets = exits.select("g", F.col("exit").alias("pos")).distinct().unionByName(exits.where("pos = 1").select("g", "pos")).distinct()
    jump = cut(exits.join(targets, ["g", "pos"], "left_semi"))
    entered = cut(jump.where("pos = 1").select("g", "pos"))
    n = entered.count()
    while True:
        there = entered.join(jump, ["g", "pos"]).select("g", F.col("exit").alias("pos"))
        entered = cut(entered.unionByName(there).distinct())
        now = entered.count()
        if now == n:
            break
        n = now
        jump = cut(jump.join(jump.select("g", F.col("pos").alias("exit"), F.col("exit").alias("_far")), ["g", "exit"], "left").select("g", "pos", F.coalesce("_far", "exit").alias("exit")))
    marked = dealt.join(F.broadcast(entered.select(F.col("g").alias("_g"), "pos", F.lit(True).alias("hit"))), ["_g", "pos"], "left")
    marked = marked.select("_g", "part", "pos", "nxt", F.coalesce("hit", F.lit(False)).alias("hit"))
    starts = _by_part(marked, "part", ["_g", "part", "pos"], _walk, "g bigint, pos bigint")
    return items.join(starts.select(F.col("g").alias("_g"), F.col("pos").alias("_pos")), ["_g", "_pos"], "left_semi").select(*by, order)


def automaton(rows: DataFrame, by: list[str], order: list[str], symbol: Column, table: list[list[int]], name: str = "state", start: int = 0, least: int = LEAST) -> DataFrame:
    """The state that a finite machine is in behind each row: table[state][symbol] is the next one; a null symbol leaves it.

    A row is a function from states to states, and functions compose: a part of a large group is one such function, those
    of a group's parts are composed in order, and each part then runs from the state that it is entered in.
    """
    s = fresh(rows, "_symbol")
    narrow = rows.withColumn(s, symbol.cast("int"))
    large = large_groups(rows, by, least)
    states, step = len(table), np.asarray(table, np.int32)

    def last_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, part, symbols in _stretches(batches):
            at = np.arange(states, dtype=np.int32)
            for x in symbols[symbols >= 0]:
                at = step[at, int(x)]
            yield pa.RecordBatch.from_arrays([pa.array(g[:1]), pa.array(part[:1]), pa.array([at.tolist()], pa.list_(pa.int32()))], ["g", "part", "f"])

    def walk(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, at = None, start
            for batch in batches:
                symbols, entry = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
                groups = zip(*(batch.column(c).to_pylist() for c in range(2, 4 + len(by))))
                made = np.empty(batch.num_rows, np.int32)
                for i, now in enumerate(groups):
                    if now != key:
                        key, at = now, int(entry[i])
                    if symbols[i] >= 0:
                        at = int(step[at, symbols[i]])
                    made[i] = at
                yield pa.RecordBatch.from_arrays([*batch.columns[4 + len(by) :], pa.array(made)], names)

        return run

    def walked(items: DataFrame, g: Column, part: Column, entry: Column, deal) -> DataFrame:
        own = [fresh(items, f"_by{k}") for k in range(len(by))]
        extra = [F.coalesce(F.col(s), F.lit(-1)).alias(fresh(items, "_symbols")), entry.cast("int").alias(fresh(items, "_from")), g.cast("bigint").alias(a := fresh(items, "_a")), part.cast("int").alias(b := fresh(items, "_b")), *[F.col(c).alias(o) for c, o in zip(by, own)]]
        chosen = deal(items.select(*extra, *[F.col(c) for c in rows.columns]), a, b, own)
        names = [*rows.columns, name]
        return chosen.sortWithinPartitions(a, b, *own, *order).mapInArrow(walk(names), rows.withColumn(name, F.lit(0)).select(*names).schema)

    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    plain = lambda df: walked(df, F.lit(0), F.lit(0), F.lit(start), lambda x, a, b, own: x.repartition(*(own or [a])))
    if large is None:
        return plain(narrow)
    few, many, g = split_large(narrow, by, large)
    dealt, part = in_parts(many, [g, *order], large.rows)
    maps = _by_part(dealt.select(F.col(g).alias("g"), F.col(part).alias("part"), F.coalesce(F.col(s), F.lit(-1)).alias("x"), *[F.col(o).alias(f"o{k}") for k, o in enumerate(order)]), "part", ["g", "part", *[f"o{k}" for k in range(len(order))]], lambda bs: last_of(pa.RecordBatch.from_arrays(b.columns[:3], ["g", "part", "x"]) for b in bs), "g bigint, part int, f array<int>")
    upto = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    entry = maps.select(F.col("g").alias(g), F.col("part").alias(part), F.aggregate(F.collect_list("f").over(upto), F.lit(start), lambda at, f: F.get(f, at)).alias("_entry"))
    both = dealt.join(F.broadcast(entry), [g, part])
    n = partitions(rows)
    done = walked(both, F.col(g), F.col(part), F.col("_entry"), lambda x, a, b, own: x.repartitionById(n, F.col(b)))
    return plain(few).unionByName(done) if by else done
