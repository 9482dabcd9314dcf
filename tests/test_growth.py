"""Steps whose work or memory once grew faster than their input, or whose rows differed from SQL on larger tables."""

import random
import time

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from docforge.functions import rules, stages
from docforge.operators import assembly, chapters, dedup, exam, layout, lineage, lines, scan
from docforge.plans import catalogue, sql_functions


def test_chunks_of_pages_far_apart(spark):
    """Chunks far apart, and a table that a plan would broadcast: its size on the driver is not that of its shuffle."""
    pages = spark.createDataFrame([(1, 5), (1, 10**15), (1, -3), (2, 7), (2, 300), (3, 1), (1, None)], "doc_id int, page_num long")
    chunks = spark.createDataFrame([(1, 1, -3, 4), (1, 2, 5, 5), (1, 3, 10**15 - 70_000, 10**15 + 70_000), (2, 2, 0, 299), (2, 1, 7, 8), (2, 3, 301, 300)], "doc_id int, chunk_index int, page_start long, page_end long")
    got = sorted(((r.doc_id, r.page_num or 0, r.chunk_index) for r in chapters.chunk_of_page(pages, chunks).collect()), key=str)
    assert got == sorted([(1, 5, 2), (1, 10**15, 3), (1, -3, 1), (2, 7, 1), (2, 300, None), (3, 1, None), (1, 0, None)], key=str)
    plan = chapters.chunk_of_page(pages, chunks)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_lines_and_tables_are_not_broadcast(spark):
    """A million rows that are alike are small in a file, so a plan would broadcast them, and large on the driver."""
    n = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("seq"), F.lit("body").alias("tag"), F.concat(F.lit("please take "), F.col("id").cast("string"), F.lit(" daily")).alias("content"))
    run = lambda t: F.array(F.struct(F.lit(t).alias("text"), F.lit(True).alias("bold"), F.lit(False).alias("italic")))
    said = n.select("doc_id", F.lit(1).alias("line_no"), F.lit("daily").alias("text"), run("daily").alias("runs")).unionByName(n.select("doc_id", F.lit(2).alias("line_no"), F.substring("content", 8, 100).alias("text"), run("take").alias("runs")))
    tables = n.select("doc_id", F.lit(1).alias("table_no"), "content", F.lit("a").alias("text"), F.array("content").alias("cells")).drop("content")
    for made in (layout.annotate(n, said), layout.match_tables(tables, tables, ["doc_id"])):
        assert made.count() == 1000
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_contents_behind_the_last_page(spark):
    """Entries behind the last page counted parts backwards, or divided by none."""
    entries = spark.createDataFrame([(1, 10, "a"), (1, 1010, "b"), (2, 500, "c"), (3, 5000, "d"), (4, 1001, "e")], "doc_id int, start_page int, title string")
    got = sorted((r.doc_id, r.title, r.start_page, r.end_page, r.parts) for r in chapters.from_contents(entries, F.lit(1000)).collect())
    assert [g for g in got if g[1] == "a"] == [(1, "a", 10, 259, 4), (1, "a", 260, 509, 4), (1, "a", 510, 759, 4), (1, "a", 760, 1009, 4)]
    assert [g for g in got if g[1] != "a"] == [(1, "b", 1010, 1000, 0), (2, "c", 500, 750, 2), (2, "c", 751, 1000, 2), (3, "d", 5000, 1000, -13), (4, "e", 1001, 1000, 0)]


def test_a_sentence_that_begins_like_chat_is_no_form(spark, tmp_path):
    """The 14th line of a document is its own; one beginning with "Here is" was counted as a form that goes."""
    text = "\n".join(["x"] * 13 + ["Here is en in this and."])
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["q60_line_predicates"](spark, str(tmp_path)).first()
    assert (got.rich_drops, got.pipe_rows, got.caps) == (2, 1, 2)


def test_sections_of_a_large_book(spark):
    """Chapters first, appendices behind them, each in chunk order, in a book that is cut into parts."""
    chunks = spark.range(18_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("chunk_index"), F.when(F.col("id") % 5 == 2, "Appendix x").when(F.col("id") % 7 == 1, F.lit(None)).otherwise("body").alias("text"), F.when(F.col("id") % 3 == 0, "PENDING").otherwise("COMPLETED").alias("status"))
    made = assembly.structured(chunks)
    got = [(r.section_order, r.section_type) for r in made.select("section_order", "section_type").orderBy("section_order").collect()]
    appendices = sum(i % 3 != 0 and i % 5 == 2 for i in range(18_000))
    kinds = ["front_matter", *["chapter"] * (12_000 - appendices), *["appendix"] * appendices, "back_matter"]
    assert got == [*zip(range(1, 12_003), kinds)]
    small = chunks.where("chunk_index < 30")
    assert [r.title for r in assembly.structured(small).where("section_type = 'appendix'").orderBy("section_order").collect()] == ["Appendix A", "Appendix B", "Appendix C", "Appendix D"]


def test_sections_need_one_look_for_large_groups(spark, monkeypatch):
    """Three scans, each made anew by those behind it, broadcast a table each several times once a group was large."""
    looks, real = [], scan.large_groups
    monkeypatch.setattr(scan, "large_groups", lambda *a, **k: looks.append(1) or real(*a, **k))
    chunks = spark.createDataFrame([(1, 1, "a", "COMPLETED"), (1, 2, "Appendix b", "COMPLETED")], "doc_id int, chunk_index int, text string, status string")
    assert assembly.publication(chunks).count() == 4 and len(looks) == 1


def test_objective_questions_are_scanned_once(spark, monkeypatch):
    """Rows were scanned by document and again by question, with their texts. An id is that of the first telling text."""
    looks, real = [], scan.large_groups
    monkeypatch.setattr(scan, "large_groups", lambda *a, **k: looks.append(1) or real(*a, **k))
    blocks = [("text", "Objective Question"), ("text", "Page 3 of 9"), ("text", "12"), ("text", "1234567"), ("text", "7654321"), ("image", None), ("text", "Objective Question"), ("text", "words"), ("text", "7654321"), ("image", None), ("image", None)]
    rows = spark.createDataFrame([(1, k, *b, 10 * k) for k, b in enumerate(blocks)], "doc_id int, seq int, kind string, text string, xref int")
    got = [(r.q_num, r.q_id, list(r.images)) for r in exam.group_objective_questions(rows).orderBy("q_num").collect()]
    assert got == [(1, "1234567", [50]), (2, "", [90, 100])] and len(looks) == 1


def test_rows_of_a_table_function_are_read_by_place():
    """Looking for a column's name in every row was much of a block's time."""

    class Places(Row):
        def __getitem__(self, at):
            assert not isinstance(at, str)
            return super().__getitem__(at)

    made = sql_functions.ObjectiveQuestions()
    row = Places(doc_id=1, seq=1, kind="text", text=None, xref=None)
    blocks = [("text", "Objective Question", None), ("text", "12 1234567", None), ("image", "", 7)]
    rows = [Places(doc_id=1, seq=k, kind=a, text=b, xref=c) for k, (a, b, c) in enumerate(blocks)]
    assert [x for r in [row, *rows] for x in made.eval(r)] == [] and [*made.terminate()] == [(1, 1, "1234567", [7])]


def test_equal_paragraphs_are_told_by_their_digest(monkeypatch):
    """Every paragraph was cut into grams, and all that each shares was counted, before its equal was looked for."""
    counted, real = [], dedup.Counter
    monkeypatch.setattr(dedup, "Counter", lambda *a: counted.append(1) or real(*a))
    step = dedup.greedy_step()
    assert [step(t) for t in ("One paragraph of some words.", "one PARAGRAPH, of some words", "Another that is unlike it", None)] == [True, False, True, True]
    assert len(counted) == 2


def test_bands_are_half_as_wide(spark):
    """Blocks carry a text's bands beside it, once a band: they were 64 bits each."""
    rows = spark.createDataFrame([(1, "one paragraph of some words"), (2, "one paragraph of some words more")], "id long, t string")
    assert dict(dedup._keys(rows, "id", "t", 40, 4).dtypes)["hs"] == "array<int>"
    assert [(r.a, r.b) for r in dedup.near_pairs(rows, "id", "t").collect()] == [(1, 2)]


def test_texts_are_moved_for_keys_that_may_be_alike(spark, monkeypatch):
    """Texts were moved once for each band whose bucket has two keys, and shuffle files stayed until a collection."""
    moved, real = [], dedup._compared
    monkeypatch.setattr(dedup, "_compared", lambda blocks, compare: moved.append(blocks.count()) or real(blocks, compare))
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcdeiorstnu") for _ in range(rng.randint(2, 4))) for _ in range(45)]
    some = ["".join(rng.choice(parts) for _ in range(40)) for _ in range(120)]
    rows = spark.createDataFrame([*enumerate(some), *((1000 + i, some[i] + "xyz") for i in range(0, 120, 2))], "id long, t string")
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: str(held.getAllBlocks()).count("shuffle_")
    before, setting = files(), spark.conf.get(lineage.FREE, None)
    groups = dedup.near_groups(rows, "id", "t")
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(lineage.FREE, None) == setting
    buckets = dedup._keys(rows, "id", "t", 40, 4).select(F.explode("hs").alias("h")).groupBy("h").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert moved == [120] and buckets > 10 * 120
    assert {r.id: r.n_like for r in groups.collect()} == {i: int(i % 2 == 0) for i in [*range(120), *range(1000, 1120, 2)]}


def test_pairs_of_several_roots_and_passes_count_once(spark, monkeypatch):
    """Bands and roots some at a time, and in parts, give what all at once gives."""
    monkeypatch.setattr(dedup, "AT_ONCE", 1)
    some = [(i, f"the same long sentence about protein and energy and fluid, number {i:03}") for i in range(40)] + [(100 + i, "protein and energy " * (i % 3 + 1) + f"or other words {i * 7919}") for i in range(30)]
    sets = {i: {*dedup._grams_of("".join(c for c in t.lower() if c.isalnum())).tolist()} for i, t in some}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.6 * len(x | y)}
    got = [((r.a, r.b), r.similarity) for r in dedup.near_pairs(spark.createDataFrame(some, "id long, t string"), "id", "t", part=8).collect()]
    assert len(got) == len(dict(got)) and {p: x for p, x in want.items() if x > 0.75}.items() <= dict(got).items() <= want.items()


def test_sketches_meet_in_small_and_large_groups():
    """Groups of any size, whole or as two parts, give the least ids that links reach within them."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 64, 65, 300, 700]
    g, side = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.full(n, 2) for n in sizes[:-1]] + [rng.integers(0, 2, 700)])
    words = [rng.integers(0, 1 << 63, 60, dtype=np.uint64)[rng.integers(0, 60, len(g))] for _ in range(2)]
    words = [words[0], words[0] ^ np.uint64(7)]
    ids = rng.permutation(len(g)).astype(np.int64)
    got = {*zip(*(x.tolist() for x in dedup._linked(g, side, ids, words, 0, tile=32)))}
    want = set()
    for n in range(len(sizes)):
        for w in np.unique(words[0][g == n]):
            same = (g == n) & (words[0] == w)
            if same.sum() > 1 and (2 in side[same] or len(set(side[same].tolist())) == 2):
                want |= {(i, ids[same].min()) for i in ids[same].tolist()}
    assert got == want


def test_patterns_share_their_beginnings(spark):
    patterns = ("now we begin", r"now we move\s+on", r"\bnext\b", r"^lay it out$", r"copy.*paste", "tea|rice", r"let'?s\s+go", r"(?:a|b)c", r"\[PAGE")
    texts = ["know we begin", "NOW WE MOVE  on", "nextly", "next", "lay it out", "so lay it out", "copy and paste", "rice", "lets go", "let's  go", "bc", "[page 2", "now we go", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = df.select(df.t.rlike(rules.factored(patterns)).alias("a"), df.t.rlike(stages.either(patterns)).alias("b")).collect()
    assert [r.a for r in same] == [r.b for r in same] and 0 < sum(r.a for r in same) < len(texts)
    # each paragraph of a book is asked for a stage's words once, not for one pattern after the other at every letter
    plan = lines.finish_book(df.withColumnRenamed("t", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "would you like|if you want" not in plan and "let'?s make|let'?s now" not in plan


def test_lines_of_pages_are_normalised_once(spark, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), lines.normalize_line

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(lines, "normalize_line", lambda c: plain(counted(c)))
    pages = spark.createDataFrame([("d", i, f"Tea is fine today {i}.\n\nSalt\nRice and more of it.") for i in range(20)], "doc_id string, page_num int, text string")
    lines.clean_pages_with_structure(pages).write.format("noop").mode("overwrite").save()
    assert seen.value == 20 * 3


def test_printed_questions_ask_once_for_large_papers(spark, monkeypatch):
    asked, plain = [], scan.large_groups
    for module in (scan, exam):
        monkeypatch.setattr(module, "large_groups", lambda *a, **k: asked.append(1) or plain(*a, **k), raising=False)
    text = "Which? [Question ID = 7]\n1. a [Option ID = 1]\n2. b [Option ID = 2]"
    made = exam.split_questions(spark.createDataFrame([(d, 1, "text", text, None) for d in range(30)], "doc_id int, seq int, kind string, text string, xref int"))
    assert made.count() == 30 and len(asked) == 1
    # a question of no named paper has its options as any other
    row = exam.split_questions(spark.createDataFrame([(None, 1, "text", text, None)], "doc_id int, seq int, kind string, text string, xref int")).first()
    assert (row.doc_id, row.q_id, row.stem) == (None, "7", "Which?") and "2. b" in row.option_text
