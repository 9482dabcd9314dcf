"""A trie of conversations by their turns, built as a Patricia tree: sorted, compressed, summed up, and then expanded.

A conversation's turns become a key, 16 bytes a turn (a digest of role and text). Equal keys are one row with how many
conversations end there. Sorted keys and how many turns each shares with the key before it determine the tree: its points
are where keys branch, where they end, and leaves; what lies between is an edge, however many turns it has. Sorted ranges
of keys are walked in parallel with a stack of the open points on the path of the last key. A range completes all points
that begin in it; what it adds to points of earlier ranges (at ever smaller depths), and the points it leaves open, are the
seam: rows on one path a range, which one streaming pass in the order of the ranges folds, with a stack as deep as a path.

Sums are made on points: members, leaves, children, smallest member, and tokens saved below. An edge then gives a row for
each of its turns: what a turn saves with all below is the point's sum and the edge's suffix sum of words, times members.

Ends are told by a digest of all their conversations' ids, which is a sequential hash: ids are sorted over many tasks and
joined in blocks of ENDS_BLOCK, and one task a key only streams its blocks through the hash, in bounded memory.

Defined results: turns are ordered by turn (null first), then role and text, so repeated rows are turns of their own in a
certain order; null role and text are empty. Rows without conv_id are no conversation's. An empty table has no node. Other
columns are not read. ``%`` keeps the sign of a negative conv_id, as SQL's does. A conversation is one row while it is
rebuilt (an array of digests and counts, no texts), however many share its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import cut, partitions, scratch
from docforge.llm.graph import spread_join
from docforge.operators import scan
from docforge.operators.sequence import numbered

STEP, SHARED, EVERY, ENDS_BLOCK = 16, 4, 20, 4096
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one it is a branch of."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, key, words): digests of the turns, 16 bytes each, and their counts of words. The first h turns are those of
    conversation c - c % 20."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sized = F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit("\n"), text)
    turns = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.select("conv_id", "turn", "role", "text", F.md5(sized).alias("d"), F.regexp_count("text", F.lit(WORD)).alias("w"))
    placed = cut(numbered(turns, ["conv_id"], ["turn", "role", "text"], "n").select("conv_id", "n", "d", "w"))
    own_shared = F.sort_array(F.collect_list(F.when(F.col("n") > shared_turns(F.col("conv_id")), F.struct("n", "d", "w"))))
    own = placed.groupBy("conv_id").agg(own_shared.alias("own"), shared_turns(F.first("conv_id")).alias("h"))
    heads = placed.where((F.col("n") < SHARED) & (F.col("conv_id") % EVERY == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("n", "d", "w"))).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).join(heads, "base", "left")
    taken = F.filter(F.coalesce("head", F.array().cast("array<struct<n:bigint,d:string,w:int>>")), lambda t: t["n"] <= F.col("h"))
    seq = both.select("conv_id", F.concat(taken, "own").alias("seq"))
    return seq.select("conv_id", F.unhex(F.array_join(F.transform("seq", lambda t: t["d"]), "")).alias("key"), F.transform("seq", lambda t: t["w"].cast("bigint")).alias("words"))


class _Point:
    """An open point: sums over the part of its subtree that is complete."""

    __slots__ = ("depth", "id", "sum", "word", "words", "n", "least", "leaves", "children", "saved", "ends")

    def __init__(self, depth, ident, total, word, words, ends=0):
        self.depth, self.id, self.sum, self.word, self.words, self.ends = depth, ident, total, word, words, ends
        self.n, self.least, self.leaves, self.children, self.saved = 0, None, 0, 0, 0

    def add_ends(self, n, least):
        self.n += n
        self.least = least if self.least is None else min(self.least, least)

    def add(self, n, least, leaves, children, saved):
        if n:
            self.add_ends(n, least)
        self.leaves, self.children, self.saved = self.leaves + leaves, self.children + children, self.saved + saved

    def close(self):
        """Its own turn saves, too; a point without children is a leaf."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.word

    def hang(self, parent: "_Point"):
        """Adds a closed point to the one above: the edge's inner turns have the same members."""
        parent.add(self.n, self.least, self.leaves, 1, self.saved + (self.n - 1) * (self.sum - self.word - parent.sum))


# kind 0: a finished edge. 1: what a range adds to the point of an earlier one at a depth. 2: a point that stays open.
ROW = "kind int, part int, at bigint, id binary, parent binary, depth bigint, words array<bigint>, total bigint, n bigint, least bigint, leaves bigint, children bigint, saved bigint, ends bigint"
NAMES = [f.split()[0] for f in ROW.split(", ")]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _digest(key: bytes, depth: int) -> bytes:
    return hashlib.md5(key[: STEP * depth]).digest()


def _edge(p: _Point, parent: _Point) -> tuple:
    """A finished point with the edge above it, told by its suffix sums: what the edge's turns from each one to the one before
    the point's come to, from the point upwards."""
    inner = p.words[len(p.words) - (p.depth - parent.depth) : -1]
    return (0, 0, 0, p.id, parent.id, p.depth, list(accumulate(reversed(inner), initial=0)), p.sum, p.n, p.least, p.leaves, p.children, p.saved, p.ends)


def _open(kind: int, part: int, at: int, p: _Point) -> tuple:
    return (kind, part, at, p.id, None, p.depth, p.words, p.sum, p.n, p.least, p.leaves, p.children, p.saved, p.ends)


def _batches(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], NAMES)


def same_turns(a: bytes, b: bytes) -> int:
    """How many turns two keys begin with in common."""
    n = min(len(a), len(b)) // STEP
    if a[: n * STEP] == b[: n * STEP]:
        return n
    x, y = (np.frombuffer(k, np.uint8, n * STEP) for k in (a, b))
    return int(np.argmax(x != y)) // STEP


def _walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edges and seam of the ranges of one task: rows (part, before, key, words, n, least) come sorted. before is the last
    key of the ranges before, where the part's first key hangs; the tree's root counts as a point of an earlier range."""
    part, key, sums, stack, low, at = None, b"", [0], [], None, 0

    def shed(to: int) -> Iterator[tuple]:
        """Closes the points deeper than ``to`` on the path of ``key``, making the branch there if there is none."""
        while stack and stack[-1].depth > to:
            p = stack.pop()
            p.close()
            if stack and stack[-1].depth >= to:
                parent = stack[-1]
            elif to > low.depth:
                first = stack[-1].depth if stack else low.depth
                parent = _Point(to, _digest(key, to), sums[to], sums[to] - sums[to - 1], [b - a for a, b in zip(sums[first:to], sums[first + 1 : to + 1])])
                stack.append(parent)
            else:
                parent = low
            yield _edge(p, parent)
            p.hang(parent)

    def finish() -> Iterator[tuple]:
        nonlocal at
        yield _open(1, part, at, low)
        for p in stack:
            at += 1
            yield _open(2, part, at, p)

    for now, before, new, words, n, least in rows:
        new_sums = np.concatenate([[0], np.cumsum(np.asarray(words, np.int64))]).tolist() if words else [0]
        if now != part:
            if part is not None:
                yield from finish()
            part, stack, at = now, [], 0
            depth = same_turns(before, new)
            low = _Point(depth, _digest(new, depth), new_sums[depth], 0, [])
        else:
            depth = same_turns(key, new)
            yield from shed(depth)
            if depth < low.depth:
                yield _open(1, part, at, low)
                at += 1
                low = _Point(depth, _digest(new, depth), new_sums[depth], 0, [])
        key, sums = new, new_sums
        last = len(key) // STEP
        if not last:
            low.add_ends(n, least)
            low.ends += n
            continue
        above = stack[-1].depth if stack else low.depth
        p = _Point(last, _digest(key, last), sums[last], words[-1], words[above:], n)
        p.add_ends(n, least)
        stack.append(p)
    if part is not None:
        yield from finish()


def _sew(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Finished edges of the points that lie on seams. Rows come in the order of the ranges; the stack is one path."""
    stack = [_Point(0, hashlib.md5(b"").digest(), 0, 0, [])]
    root, some = stack[0], False
    for kind, _, _, ident, _, depth, words, total, n, least, leaves, children, saved, ends in rows:
        some = True
        if kind == 1:
            while stack[-1].depth > depth:
                p = stack.pop()
                p.close()
                if stack[-1].depth < depth:
                    # the branch lies on the edge above p
                    inner = p.words[: depth - stack[-1].depth]
                    stack.append(_Point(depth, ident, total, inner[-1], inner))
                yield _edge(p, stack[-1])
                p.hang(stack[-1])
            stack[-1].add(n, least, leaves, children, saved)
            stack[-1].ends += ends
        else:
            p = _Point(depth, ident, total, words[-1], words, ends)
            p.add(n, least, leaves, children, saved)
            stack.append(p)
    while len(stack) > 1:
        p = stack.pop()
        p.close()
        yield _edge(p, stack[-1])
        p.hang(stack[-1])
    if some:
        root.close()
        yield (0, 0, 0, root.id, None, 0, [0], 0, root.n, root.least, root.leaves, root.children, root.saved, root.ends)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def compressed(keys: DataFrame) -> DataFrame:
    """Edges of the Patricia tree of (key, words, n, least), one row a point with all sums."""
    dealt, part = scan.in_parts(keys, ["key"])
    last = dealt.groupBy(part).agg(F.max("key").alias("last"))
    before = last.select(part, F.coalesce(scan.Running(F.col("last"), "max").carried("last", scan.Window.orderBy(part)), F.lit(b"")).alias("before"))
    told = dealt.join(F.broadcast(before), part).select(F.col(part).alias("part"), "before", "key", "words", "n", "least")
    made = cut(told.repartitionById(partitions(keys.sparkSession), F.col("part")).sortWithinPartitions("part", "key").mapInArrow(lambda bs: _batches(_walk(_rows(bs))), ROW))
    seam = made.where("kind > 0").coalesce(1).sortWithinPartitions("part", "at").mapInArrow(lambda bs: _batches(_sew(_rows(bs))), ROW)
    return cut(made.where("kind = 0").unionByName(seam))


def digests_of_ends(members: DataFrame, block: int = ENDS_BLOCK) -> DataFrame:
    """(id, ends_sha256) of (id, conv_id): the hash of each id's conversations in ascending order. See the module's text."""
    placed = numbered(members, ["id"], ["conv_id"], "k")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = placed.groupBy("id", F.floor((F.col("k") - 1) / block).alias("b")).agg(joined.alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = None, []
        for batch in batches:
            for ident, s in zip(batch.column(0).to_pylist(), batch.column(2)):
                if ident != now:
                    if now is not None:
                        made.append((now, h.hexdigest()))
                    now, h = ident, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(s.as_py().encode())
            if len(made) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.binary(), pa.string()))], ["id", "ends_sha256"])
                made = []
        if now is not None:
            made.append((now, h.hexdigest()))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.binary(), pa.string()))], ["id", "ends_sha256"])

    return blocks.repartition(partitions(members.sparkSession), "id").sortWithinPartitions("id", "b").mapInArrow(run, "id binary, ends_sha256 string")


def conversation_trie(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node, the root
    with its null parent included."""
    spark = rows.sparkSession
    path = scratch(spark, "conversations")
    rebuilt(rows).withColumn("id", F.unhex(F.md5("key"))).write.parquet(path)
    members = spark.read.parquet(path)
    keys = cut(members.groupBy("id", "key").agg(F.any_value("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least")).drop("id"))
    points = compressed(keys)
    ends = digests_of_ends(members.select("id", "conv_id"))
    n = points.count()
    up = spread_join(points.where("parent IS NOT NULL"), points.select(F.col("id").alias("parent"), F.col("least").alias("above")), ["parent"], n)
    top = points.where("parent IS NULL").withColumn("above", F.lit(None).cast("bigint"))
    told = up.unionByName(top).join(ends, "id", "left")
    length = F.size("words")
    nodes = told.select("*", F.posexplode("words").alias("up", "below"))
    inner = F.col("up") > 0
    parent = F.when(F.col("up") < length - 1, F.col("least")).otherwise(F.col("above"))
    return nodes.select(
        F.col("least").alias("conv_id"), (F.col("depth") - F.col("up")).cast("bigint").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(inner, F.lit(1).cast("bigint")).otherwise(F.col("children")).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("below")).alias("saved_tokens"),
        F.when(inner | F.col("ends_sha256").isNull(), F.lit(EMPTY)).otherwise(F.col("ends_sha256")).alias("ends_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every conversation."""
    from docforge.llm.common import table

    return conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


SQL = r"""
WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
        lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda q, i: xor(q >> 1, 3988292384::BIGINT * (q & 1)))), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT h.c, t.n, t.x FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.n <= h.h UNION ALL SELECT h.c, t.n + 1000000000, t.x FROM h JOIN t ON t.c = h.c AND t.n > h.h),
s AS MATERIALIZED (SELECT h.c, coalesce(q.s, []) AS s FROM h LEFT JOIN (SELECT c, list(x ORDER BY n) AS s FROM u GROUP BY c) q ON q.c = h.c),
p AS MATERIALIZED (SELECT c, d, s[1:d] AS p, len(s) = d AS ended, s[d].t AS last FROM s, range(0, 1000) r(d) WHERE d <= len(s)),
k AS MATERIALIZED (SELECT p, d, min(c) AS c, count(*) AS n, any_value(last) AS last, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '')) AS e FROM p GROUP BY p, d),
j AS MATERIALIZED (SELECT b.p, b.d, b.c AS conv_id, a.c AS parent_conv_id, b.n, b.e, CASE WHEN b.d = 0 THEN 0 ELSE (b.n - 1) * len(regexp_extract_all(b.last, '[^\x20\x09-\x0D]+')) END AS saves FROM k b LEFT JOIN k a ON a.d = b.d - 1 AND a.p = b.p[1:b.d - 1]),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS m FROM j WHERE d > 0 GROUP BY 1, 2),
w AS MATERIALIZED (SELECT j.*, coalesce(m, 0) AS m FROM j LEFT JOIN kids USING (p, d)),
up AS (SELECT w.p[1:r.d] AS p, r.d, CAST(sum(w.saves) AS BIGINT) AS saved, count(*) FILTER (WHERE w.m = 0) AS leaves FROM w, range(0, 1000) r(d) WHERE r.d <= w.d GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, w.parent_conv_id, w.n AS n_convs, w.m AS n_children, up.leaves AS n_leaves, up.saved AS saved_tokens, w.e AS ends_sha256 FROM w JOIN up ON up.p = w.p AND up.d = w.d"""
