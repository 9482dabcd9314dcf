"""Golden cases of the operators, derived by reading the rules."""

import pytest
from pyspark.sql import functions as F

from docforge.functions import answers as A
from docforge.functions import render, rules
from docforge.functions import text as T
from docforge.operators import assembly, chapters, dedup, exam, keys, layout, lifecycle, lines, models, quality, review, sequence
from docforge.sources import sinks, tables


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("Mail a.b@x.org now", "Mail now"), ("Phone: +91 98765 43210 ok", "ok"), ("id 1234567890 and 12345678901", "id and 12345678901"), ("a ‘b’ — \U0001f600c ● d 1⃣", "a 'b' - c - d 1.")])
def test_normalize_line(spark, given, want):
    assert one(spark, T.normalize_line(F.col("s")), s=given) == want


@pytest.mark.parametrize(("given", "want"), [("HbA1c 5mg,daily", "Hb A1 c 5 mg, daily"), ("proteinIntake vitamin b12", "protein Intake vitamin b 12")])
def test_split_fused(spark, given, want):
    assert one(spark, T.split_fused(F.col("s")), s=given) == want


@pytest.mark.parametrize(("line", "dropped"), [("Perfect!", True), ("Page 3 of 9", True), ("12.", True), ("yes", True), ("", False), ("The renal diet limits potassium.", False), ("| a | b |", True), ("Let me explain", True)])
def test_should_drop(spark, line, dropped):
    assert bool(one(spark, rules.should_drop(F.col("s")), s=line)) is dropped


@pytest.mark.parametrize(("text", "mostly"), [("1. नमस्ते दुनिया", True), ("Option A नम", False), ("12. 34", False)])
def test_script_share(spark, text, mostly):
    assert one(spark, T.is_mostly(F.col("s")), s=text) is mostly


@pytest.mark.parametrize(("a", "b", "want"), [("The quick brown fox jumps over the lazy dog.", "The quick brown fox jumped over the lazy dog!", 28 / 37), ("Protein needs rise during illness.", "Fluid needs fall during recovery.", 5 / 46)])
def test_jaccard_of_grams(spark, a, b, want):
    g = lambda c: T.grams(T.paragraph_key(F.col(c)))
    assert one(spark, T.jaccard(g("a"), g("b")), a=a, b=b) == pytest.approx(want)
    assert dedup.greedy_flags([a, b]) == [True, want < 0.6]


def test_short_strings_have_no_grams(spark):
    assert one(spark, T.grams(F.col("s")), s="abc") == []


TABLE = "Food" + " " * 9 + "Energy\nRice" + " " * 9 + "130\nLentils" + " " * 6 + "116"


@pytest.mark.parametrize(("block", "want"), [(TABLE, "Food | Energy\nRice | 130\nLentils | 116"), ("a   b\nc   d\ne   f", None), ("a    b\nc    d", None), ("    a    b\n    c    d\n    e    f", " | a | b\n | c | d\n | e | f")])
def test_column_table(spark, block, want):
    assert lines.column_table(block.split("\n")) == want
    assert one(spark, lines.column_table_sql(F.col("s")), s=block) == want
    assert one(spark, lines.column_tables(F.col("s")), s=block) == want


@pytest.mark.parametrize(("raw", "kind", "options"), [("2", "single", [2]), ("3,1", "multi", [1, 3]), ("3 or 4", "or", [3, 4]), ("DROP", "drop", []), ("x", "unknown", [])])
def test_classify(spark, raw, kind, options):
    a = one(spark, A.classify(F.col("s")), s=raw)
    assert (a.kind, a.options) == (kind, options)


def test_classify_blank_is_null(spark):
    assert one(spark, A.classify(F.col("s")), s=" ") is None


@pytest.mark.parametrize(("raw", "kind", "options"), [("503", "single", [503]), ("504, 501,", "multi", [501, 504]), ("*", "drop", []), ("501*", "single", [501]), ("Dropped", "drop", []), ("a", "unknown", [])])
def test_classify_short(spark, raw, kind, options):
    a = one(spark, A.classify_short(F.col("s")), s=raw)
    assert (a.kind, a.options) == (kind, options)


@pytest.mark.parametrize(("raw", "kind", "options"), [("129 ,132", "multi", [129, 132]), ("7,7", "single", [7]), ("161(English)/Dropped(Hindi)", "unknown", []), ("dropped", "drop", [])])
def test_classify_listed(spark, raw, kind, options):
    a = one(spark, A.classify_listed(F.col("s")), s=raw)
    assert (a.kind, a.options) == (kind, options)


def test_show(spark):
    assert one(spark, A.show(A.classify(F.col("s"))), s="3 or 4") == "Correct Option: 3 or 4  (either accepted)"


@pytest.mark.parametrize(("raw", "kind", "text", "found"), [("503", "single", "Correct Option: 3", True), ("501, 504", "multi", "Correct Options: 1, 4  (multiple correct)", True), ("2", "single", "Correct Option: 2", True), ("999", "single", "Answer key references unknown Option ID: 999 (raw: 999)", True), ("501 or 9", "or", "Correct Option: 1", True), ("", "single", "Answer key not found for this question", False)])
def test_resolve(spark, raw, kind, text, found):
    options = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(str(500 + i)).alias("option_id")) for i in (1, 2, 3, 4)])
    r = one(spark, A.resolve(F.col("raw"), F.col("kind"), options), raw=raw, kind=kind)
    assert (r.text, r.found) == (text, found)


def test_key_of_one_page(spark):
    pages = spark.createDataFrame([(1, 1, "Subject: (703) LIFE SCIENCES\n703001  2\n703002  1,3\n703003\n703004  Drop"), (1, 2, "703005  1,2")], "doc_id int, page_num int, text string")
    got = {r.question_id: (r.kind, list(r.options), r.subject.code) for r in keys.parse(pages).collect()}
    assert got == {"703001": ("single", [2], "703"), "703002": ("multi", [1, 3], "703"), "703003": ("unrecognised", [], "703"), "703004": ("drop", [], "703"), "703005": ("multi", [1, 2], "703")}


def test_key_of_lines(spark):
    pages = spark.createDataFrame([(1, 1, "Correct Option ID\n1\n503\n2\n129 ,132\nfooter\n9\nfooter\n*3\nDropped\nSubject: Life Science"), (1, 2, "4\n7")], "doc_id int, page_num int, text string")
    got = {r.question_id: (r.kind, list(r.options)) for r in keys.parse(pages).collect()}
    assert got == {"1": ("single", [503]), "2": ("multi", [129, 132]), "3": ("drop", [])}


def test_key_of_option_ids(spark):
    text = "Subject: (703) LIFE SCIENCES\nQuestion ID  Correct Option ID\n703001  9000011\n703002  9000012,\n9000013\n703003  Drop"
    got = {r.question_id: (r.kind, r.raw, list(r.options)) for r in keys.parse(spark.createDataFrame([(1, 1, text)], "doc_id int, page_num int, text string")).collect()}
    assert got == {"703001": ("single", "9000011", [9000011]), "703002": ("multi", "9000012, 9000013", [9000012, 9000013]), "703003": ("drop", "Drop", [])}


def test_paper_format(spark):
    q, o = "Question Number : 1", "Objective Question"
    rows = [(1, i, "text", t) for i, t in enumerate([o, o, o, q, q, q, q])] + [(2, i, "text", t) for i, t in enumerate([o, q])]
    got = {r.doc_id: r.format for r in exam.paper_format(spark.createDataFrame(rows, "doc_id int, seq int, kind string, text string")).collect()}
    assert got == {1: "objective", 2: "standard"}


def test_best_subject(spark):
    answers = spark.createDataFrame([("A", 1, 1), ("A", 2, 1), ("B", 2, 2), ("B", 3, 2)], "subject string, q_id int, subject_order int")
    got = {r.subject: (r.overlap, r.best) for r in exam.best_subject(spark.createDataFrame([(2,)], "q_id int"), answers).collect()}
    assert got == {"A": (1, True), "B": (1, False)}


@pytest.mark.parametrize(("line", "tag"), [("Chapter 1 Basics", "H1"), ("1. Intro", "H2"), ("1.1 Scope", "H3"), ("- item", "list"), ("Sure, let us go", "body"), ("plain", "body"), ("Assistant: 1. Intro", "body"), ("| a | b |", "table")])
def test_tags(spark, line, tag):
    assert one(spark, rules.tag_of(F.col("s")), s=line) == tag


def test_tag_blocks_keep_code_and_tables_together(spark):
    rows = [(1, i, x) for i, x in enumerate(["| a | b |", "| c | d |", "", "| e | f |", "```", "x = 1", "", "```", "```", "y", "```", "text"])]
    got = [(r.tag, r.content) for r in sequence.tag_blocks(spark.createDataFrame(rows, "doc int, line_no int, line string"), ["doc"]).orderBy("run").collect()]
    assert got == [("table", "| a | b |\n| c | d |"), ("table", "| e | f |"), ("code", "x = 1\n"), ("code", "y"), ("body", "text")]


def test_join_continuations(spark):
    def twin(xs):
        out = []
        for x in map(str.strip, xs):
            if out and out[-1] and x and len(out[-1]) + 1 + len(x) <= 400 and out[-1][-1] not in ".!?;:" and (x[0].islower() or x[0].isdigit() or x[0] in "([\"'") and not x.startswith(("1. ", "a) ")):
                out[-1] += " " + x
            else:
                out.append(x)
        return out

    for xs in (["The patient should", "eat more protein."], ["Done.", "next"], ["a", "1. item", "b"], ["x" * 390, "yyyyyyyyyyyy"], ["", "a"]):
        got = spark.createDataFrame([(xs,)], "xs array<string>").select(sequence.join_continuations(F.col("xs")).alias("x")).first().x
        assert got == twin(xs)


def test_chapters_pack(spark):
    starts = spark.createDataFrame([(1, 3, "A"), (1, 10, "B"), (1, 14, "C")], "doc_id int, page int, title string")
    pages = spark.range(1, 21).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page_num"))
    got = [(r.page_start, r.page_end, r.title) for r in chapters.pack_chapters(chapters.ranges(starts, pages), 10).orderBy("page_start").collect()]
    assert got == [(1, 9, "Preamble – A"), (10, 13, "B"), (14, 20, "C")]


def test_translations(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 3, 0), (2, 4, 1)], "q_num int, seq int, images int")
    kept, dropped = dedup.translations(rows, [])
    assert sorted((r.q_num, r.seq) for r in kept.collect()) == [(1, 1), (2, 4)]
    assert dropped.count() == 1


def test_last_wins(spark):
    rows = spark.createDataFrame([(7, 1, "1"), (7, 2, "2")], "id int, seq int, raw string")
    last, log = dedup.last_wins(rows, ["id"], ["seq"], "raw")
    assert last.first().raw == "2"
    assert [(r.id, r.prev, r.new) for r in log.collect()] == [(7, "1", "2")]


def test_current_version(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False)], "section_id int, version int, is_edited boolean")
    assert review.current_version(rows).first().version == 2


@pytest.mark.parametrize(("old", "new", "fine"), [("Give 5 mg daily", "Give 15 mg daily", True), ("Give 5 mg daily", "Give 6 mg daily", False), ("Use Aspirin", "Use it", False)])
def test_keeps_facts(spark, old, new, fine):
    assert one(spark, render.keeps_facts(F.col("a"), F.col("b")), a=old, b=new) is fine


def test_escape(spark):
    assert one(spark, render.escape_typst(F.col("s")), s="a#b") == "a\\#b"
    assert one(spark, render.escape_typst(F.col("s"), True), s="a#b") == "a\\\\#b"


def test_questions_and_options(spark):
    text = "1. Stem one [Question ID = 11]\n1. red [Option ID = 1]\n2. blue [Option ID = 2]\nStem two [Question ID = 12]\n1. x [Option ID = 3]"
    got = {r.q_id: (r.stem, [(o.number, o.text, o.option_id) for o in r.o]) for r in exam.split_questions(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("q_id", "stem", exam.options_of(F.col("option_text")).alias("o")).collect()}
    assert got == {"11": ("1. Stem one", [(1, "red", "1"), (2, "blue", "2")]), "12": ("Stem two", [(1, "x", "3")])}


def test_labelled_output(spark):
    raw = "noise\n[H1] Title\n[TABLE|NR] a | b\nc | d\n[ODD] text\nmore"
    got = [(b.block_type, b.needs_rewrite, b.text) for b in one(spark, models.labelled(F.col("s")), s=raw)]
    assert got == [("H1", False, "Title"), ("TABLE", True, "a | b\nc | d"), ("BODY", False, "text more")]


def test_pool_rests_and_recovers():
    now, calls = [0.0], []

    def limited(prompt):
        calls.append("a")
        raise models.RateLimited

    pool = models.Pool([limited, lambda p: calls.append("b") or p.upper()], sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])
    assert [pool.call("x"), pool.call("y")] == ["X", "Y"]
    assert calls == ["a", "b", "b"]
    assert models.back_off(9, True) == 60 and models.back_off(9, False) == 30


def test_model_errors_stay_rows(spark):
    def model(t):
        if t == "bad":
            raise ValueError("no")
        return t.upper()

    got = {r.id: (r.answer, r.error) for r in models.label_and_rewrite(spark.createDataFrame([(1, "a"), (2, "bad")], "id int, t string"), "id", "t", model).collect()}
    assert got == {1: ("A", None), 2: (None, "no")}


def test_lifecycle(spark):
    docs = spark.createDataFrame([(1, "READY"), (2, "PROCESSING")], "document_id int, status string")
    after, refused = lifecycle.start_jobs(docs, spark.createDataFrame([(1,), (2,)], "document_id int"))
    assert {r.document_id: r.status for r in after.collect()} == {1: "PROCESSING", 2: "PROCESSING"}
    assert [r.document_id for r in refused.collect()] == [2]
    assert {r.status for r in lifecycle.crash_cleanup(after).collect()} == {"FAILED"}
    left = lifecycle.delete_documents({"d": docs}, docs.where("document_id = 1"))["d"]
    assert [r.document_id for r in left.collect()] == [2]
    chunks = spark.createDataFrame([(1, 0, "FAILED", "t")], "chunk_id int, retry_count int, status string, text string")
    again = lifecycle.rerun_chunks(chunks, chunks.select("chunk_id")).first()
    assert (again.retry_count, again.status, again.text) == (1, "PENDING", None)


def test_validators(spark):
    rows = spark.createDataFrame([(1, "ok@x.org"), (2, None), (3, "bad")], "id int, mail string")
    got = sorted(r.id for r in quality.violations(rows, "id", {"mail": quality.is_email(F.col("mail"))}).collect())
    assert got == [2, 3]
    assert one(spark, quality.allowed_keys(F.col("s"), ["a", "b"], ["a"]), s='{"a": 1, "b": 2}') is True
    assert one(spark, quality.allowed_keys(F.col("s"), ["a"], ["a"]), s='{"a": 1, "b": 2}') is False


def test_layout(spark):
    spans = spark.createDataFrame([(1, 1, 1, 1, 1, "Big", 14.0, True, False, 10.0), (1, 1, 2, 1, 1, "small", 10.0, False, False, 5.0), (1, 1, 2, 2, 1, "small too", 10.0, False, False, 20.0)], "doc_id int, page_num int, block_no int, line_no int, span_no int, text string, size double, bold boolean, italic boolean, y0 double")
    got = {r.text: r.item_type for r in layout.lines_from_spans(spans).collect()}
    assert got == {"Big": "heading-1", "small": "body", "small too": "body"}


def test_drop_chain(spark):
    docs = spark.createDataFrame([(1, "Intro note. Keep me.\n12.\n\nDROP this paragraph\n\nLast. The end.")], "doc_id int, text string")
    out = lines.drop_chain(docs, [{"paragraph": "^DROP", "line": rules.LONE_NUMBER, "sentence": "^Intro"}]).first().text
    assert out == "Keep me.\n\nLast. The end."


def test_clean_pages(spark):
    docs = spark.createDataFrame([(1, f"Perfect!\nproteinIntake is 5mg\n\n{TABLE}\n\n12.")], "doc_id int, text string")
    assert lines.clean_pages(docs).first().text == "protein Intake is 5 mg\n\nFood | Energy\nRice | 130\nLentils | 116"


def test_cleaning_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "a  b\n\nSome text here,  with blanks")], "doc_id int, text string")
    once = lines.clean_pages(docs)
    assert lines.clean_pages(once).first().text == once.first().text


def test_greedy_output_is_a_subset_in_order():
    texts = ["alpha beta gamma", "alpha beta gamma!", "short", "alpha beta gamma delta", "other words entirely", ""]
    assert dedup.greedy_flags(texts) == [True, False, True, False, True, True]
    assert dedup.greedy_flags(["same words again"] * 3, window=1) == [True, False, False]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "tagged_chunk_10.json").write_text('[{"tag": "H1", "content": "b"}]')
    (tmp_path / "tagged_chunk_9.json").write_text('[{"type": "list", "content": "a"}, {"content": "c"}]')
    got = [(r.file_no, r.tag, r.content) for r in tables.read_tagged(spark, str(tmp_path)).orderBy("file_no", "seq").collect()]
    assert got == [(9, "list", "a"), (9, "body", "c"), (10, "H1", "b")]
    assert tables.storage_bytes(spark, str(tmp_path)).first().files == 2
    pages = [(p.page_num, p.text) for p in one(spark, tables.split_page_marks(F.col("s")), s="x===== PAGE 1\nhello\n===== PAGE 2\nyou")]
    assert pages == [(1, "hello"), (2, "you")]
    blocks = spark.createDataFrame([(1, 1, 1, "H1", "T"), (1, 1, 2, "body", "a"), (1, 1, 3, "body", "b#")], "doc_id int, chunk_index int, seq int, tag string, content string")
    assert sinks.book(sinks.fragments(blocks), "head\n").first().book == "head\n= T\n\na b\\#"
    names = sinks.unique_names(spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf")], "i int, name string"), "name", "i")
    assert [r.archive_name for r in names.orderBy("i").collect()] == ["a.pdf", "a_1.pdf"]


def test_publication(spark):
    chunks = spark.createDataFrame([("d", 1, "Chapter 1 One\ntext", "COMPLETED"), ("d", 2, "Appendix A\nx", "COMPLETED"), ("d", 3, "plain", "FAILED")], "doc_id string, chunk_index int, text string, status string")
    got = [(r.section_type, r.title) for r in assembly.publication(chunks).orderBy("section_order").collect()]
    assert got == [("front_matter", "Front Matter"), ("chapter", "Chapter 1 One"), ("appendix", "Appendix A"), ("back_matter", "Back Matter")]


def test_stream_counts_equal_batch(spark, tmp_path):
    from docforge.streaming.events import event_stream, windowed_counts

    events = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "i int, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("i") * 1800)).drop("i")
    events.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(event_stream(spark, str(tmp_path / "in"), events.schema)).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(events).collect()))


def test_sql_functions(spark):
    from docforge.plans.sql_functions import register

    assert "line_tag" in register(spark)
    r = spark.sql("SELECT normalize_line('a  b ‘c’') AS a, split_fused('x5mg') AS b, line_tag('1.1 Scope') AS c, line_rule('Perfect!') AS d, word_count(' a b ') AS e, escape_typst('#1') AS f, redact_personal_data('me@x.org') AS g").first()
    assert tuple(r) == ("a b 'c'", "x 5 mg", "H3", "start", 2, "\\#1", "")


def test_short_ids_behind_a_named_subject(spark):
    pages = spark.createDataFrame([(1, 1, "Subject :\nLIFE - Life Science\nQuestion ID\nCorrect Key\n101\n503\n102\n501, 504,\n103\n*")], "doc_id int, page_num int, text string")
    got = {r.question_id: (r.kind, list(r.options)) for r in keys.parse(pages).collect()}
    assert got == {"101": ("single", [503]), "102": ("multi", [501, 504]), "103": ("drop", [])}


def test_across_chunks(spark):
    rows = [("d", 1, "first paragraph here\n\nsecond one is here"), ("d", 2, "first paragraph here!\n\nthird one is new"), ("e", 1, "first paragraph here")]
    got = {(r.doc_id, r.chunk_index): r.text for r in dedup.across_chunks(spark.createDataFrame(rows, "doc_id string, chunk_index int, text string")).collect()}
    assert got == {("d", 1): rows[0][2], ("d", 2): "third one is new", ("e", 1): rows[2][2]}


def test_parse_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    got = sorted((r.path[-5:], r.page_num, r.text, r.error is None) for r in tables.parse_files(spark, str(tmp_path), lambda b: b.decode().split("\x0c")).collect())
    assert got == [("a.pdf", 1, "one", True), ("a.pdf", 2, "two", True), ("b.pdf", None, None, False)]


def test_turns_of_null_and_large_keys(spark):
    rows = [(None, 1, 5), (None, 2, 5), (2**60 + 1, 1, 5), (2**60 + 1, 2, 6), (2**60, 1, 20)]
    got = {(r.g, r.o): r.bin for r in sequence.pack(spark.createDataFrame(rows, "g bigint, o bigint, s int"), ["g"], "o", "s", 10).collect()}
    assert got == {(None, 1): 0, (None, 2): 0, (2**60 + 1, 1): 0, (2**60 + 1, 2): 1, (2**60, 1): 0}
    assert sequence.pack(spark.createDataFrame([], "g bigint, o bigint, s int"), ["g"], "o", "s", 10).count() == 0


def test_column_tables_in_the_jvm_and_in_python(spark):
    """Random blocks, some wider than one number of bits."""
    import random

    rng = random.Random(1)
    blocks = []
    for _ in range(300):
        widths = [rng.randint(1, 70) for _ in range(rng.randint(1, 4))]
        row = lambda: "".join(("ab" * 40)[: rng.randint(0, w)].ljust(w + rng.choice([0, 3, 4, 5])) for w in widths)  # noqa: E731, B023
        blocks.append("\n".join((" " * rng.choice([0, 4]) + row()).rstrip() or "x" for _ in range(rng.randint(1, 5))))
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, b string")
    got = {r.i: r.t for r in df.select("i", lines.column_table_sql(F.col("b")).alias("t")).collect()}
    assert got == {i: lines.column_table([x for x in b.split("\n") if x.strip()]) for i, b in enumerate(blocks)}
    assert sum(t is not None for t in got.values()) > 50


def plain_greedy(texts, window=120):
    """The rule itself: every paragraph against each of the last kept ones."""
    kept, flags = [], []
    for t in texts:
        key = "".join(c for c in (t or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
        if len(key) < 8:
            flags.append(True)
            continue
        own = {key[i : i + 4] for i in range(len(key) - 3)}
        like = any(len(own & g) / len(own | g) >= 0.6 for _, g in kept[-window:]) or any(k == key for k, _ in kept)
        flags.append(not like)
        if not like:
            kept.append((key, own))
    return flags


@pytest.mark.parametrize("window", [1, 3, 120])
def test_greedy_fold_against_its_rule(window):
    import random

    rng = random.Random(window)
    words = ["protein", "energy", "fluid", "salt", "rice", "lentil", "renal", "diet", "x1", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(600)]
    assert dedup.greedy_flags(texts, window) == plain_greedy(texts, window)


def test_near_pairs_of_a_crowded_band(spark):
    """Many texts that are all alike: every pair is found, in parts of a bucket, as by comparing all."""
    import itertools

    rows = [(i, f"the same long sentence about protein and energy and fluid, number {i:03}") for i in range(60)] + [(100 + i, f"quite other words {i * 7919} here {i}") for i in range(20)]
    grams = {i: {k[j : j + 4] for j in range(len(k) - 3)} for i, t in rows for k in ["".join(c for c in t.lower() if c.isalnum())]}
    want = {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.6}
    df = spark.createDataFrame(rows, "id bigint, t string")
    assert {(r.a, r.b) for r in dedup.near_pairs(df, "id", "t", part=8).collect()} == want
    likes = {r.id: (r.representative, r.n_like) for r in dedup.near_groups(df.union(df.where("id = 0").selectExpr("500L", "t")), "id", "t").collect()}
    assert likes[500] == likes[0] and likes[0][1] == sum(0 in p for p in want)


def test_kinds_of_unread_answers_are_counted(spark):
    """An answer of no known form, an id without one, and a repeated id, end to end."""
    text = "Subject: (703) LIFE SCIENCES\n703001  zzz\n703002  2\n703003\n703002  3\n703004  Drop"
    parsed = keys.parse(spark.createDataFrame([(1, 1, text)], "doc_id int, page_num int, text string"))
    r = keys.key_report(parsed).first()
    assert (r.code, r.entries, r.unrecognised, r.duplicates) == ("703", 3, 2, 1)
    assert r.warnings == ["Subject 703 (LIFE SCIENCES): 2 unrecognised answer token(s)", "Subject 703: 1 duplicate question id(s) overwritten"]
    _, log = keys.entries_of(parsed)
    assert [(x.question_id, x.prev, x.new) for x in log.collect()] == [("703002", "2", "3")]
    w = keys.warnings(parsed.withColumn("subject", F.col("subject.name")), log.withColumn("subject", F.lit("LIFE SCIENCES"))).first()
    assert (w.unrecognised, w.duplicates) == (2, 1)


def test_answers_of_repeated_ids_repeat_no_question(spark):
    qs = spark.createDataFrame([("1",), ("2",), ("",)], "q_id string")
    answers = spark.createDataFrame([("1", "a"), ("1", "a"), ("3", "c")], "question_id string, answer string")
    assert sorted((r.q_id, r.found) for r in exam.with_answers(qs, answers).collect()) == [("", False), ("1", True), ("2", False)]


def test_structured_page_cleaner(spark):
    """Headers once a document, continuations joined, headings once a page, short blocks gone, both table passes."""
    rows = [
        (1, 1, f"CHAPTER 1: Basics\n\nCHAPTER 1: Basics\n\nThe patient should\neat more protein.\n\nshort one\n\n{TABLE}\n\nCondition / Key Nutrition Focus / Supportive Nutrients"),
        (1, 2, "Food         Energy\nand more words follow here\n\nCondition / Key Nutrition Focus / Supportive Nutrients\n\nPerfect!"),
        (2, 1, "Food         Energy of another book is kept"),
        (2, 2, ""),
    ]
    got = {(r.doc_id, r.page_num): r.text for r in lines.clean_pages_with_structure(spark.createDataFrame(rows, "doc_id int, page_num int, text string")).collect()}
    assert got == {
        (1, 1): "CHAPTER 1: Basics\n\nThe patient should eat more protein.\n\nFood | Energy\nRice | 130\nLentils | 116\n\nCondition / Key Nutrition Focus / Supportive Nutrients",
        (1, 2): "and more words follow here",
        (2, 1): "Food Energy of another book is kept",
        (2, 2): "",
    }


def test_generations_of_book_filters(spark):
    text = "If you want more.\nKeep this line. Next Step is here. The end of it.\n12.\nBreakfast rice 5mg\nemail: me@x.org now. We can structure it. Good advice stays."
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert lines.drop_artifacts(df, 1).first().text == text.split("\n", 1)[1]
    assert lines.drop_artifacts(df, 2).first().text == "If you want more.\nKeep this line.\nThe end of it.\n12.\nBreakfast rice 5mg\nemail: me@x.org now.\nWe can structure it.\nGood advice stays."
    assert lines.drop_artifacts(df, 3, first_part=F.lit(True)).first().text == "Keep this line.\nThe end of it.\nBreakfast rice 5 mg\nemail: now.\nGood advice stays."


def test_blocks_before_rendering(spark):
    rows = [(1, i, tag, t) for i, (tag, t) in enumerate([("H1", "Intro"), ("body", "Protein needs rise during illness."), ("H2", "intro "), ("body", "Protein needs rise during an illness!"), ("body", ""), ("body", "ok"), ("body", "ok"), ("H1", "Other"), ("body", "Fluid needs fall during recovery.")])]
    got = dedup.blocks_before_rendering(spark.createDataFrame(rows, "doc_id int, seq int, tag string, content string"), ["doc_id"]).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 1, 5, 7, 8]


def test_two_passes_and_their_fallbacks(spark):
    rows = [("d", i, t) for i, t in enumerate(["Intro here", "| a | bb |\n| cc | dd |", "Give 5 mg daily", "Use Aspirin"])] + [("bad", 0, "left as it is"), ("bad", 1, "this too")]
    df = spark.createDataFrame(rows, "doc string, seq int, text string")

    def label(prompt):
        if "left" in prompt:
            raise ValueError("no")
        return "[H1] Intro here\n[TABLE|NR] | a | bb |\n[BODY|NR] Give 5 mg daily\n[BODY|NR] Use Aspirin"

    def rewrite(prompt):
        return "Give 5 mg each day" if "5 mg daily" in __import__("json").loads(prompt)["text"] else "Use it"

    got = models.transform(df, label, rewrite, ["doc"]).orderBy("doc", "seq").collect()
    assert [(r.doc, r.block_type, r.text, r.rewritten, r.fallback) for r in got] == [
        ("bad", "BODY", "left as it is", False, True), ("bad", "BODY", "this too", False, True),
        ("d", "H1", "Intro here", False, False), ("d", "TABLE", "| a | bb |\n| cc | dd |", False, True), ("d", "BODY", "Give 5 mg each day", True, False), ("d", "BODY", "Use Aspirin", False, True),
    ]


def test_rate_limits_use_up_no_attempt():
    calls, slept = [], []

    def limited(prompt):
        calls.append("a")
        raise models.RateLimited

    state = {"n": 0}

    def shaky(prompt):
        calls.append("b")
        state["n"] += 1
        if state["n"] < 3:
            raise ValueError("down")
        return prompt.upper()

    pool = models.RotatingPool([limited] * 9 + [shaky], attempts=3, sleep=slept.append)
    assert pool.call("x") == "X" and calls == ["a"] * 9 + ["b"] * 3 and slept == [2.0] * 9 + [1.0] * 2
    with pytest.raises(ValueError):
        models.RotatingPool([lambda p: (_ for _ in ()).throw(ValueError("no"))], attempts=2, sleep=slept.append).call("x")


def test_docx_bodies_and_archives(spark, tmp_path):
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:sectPr/></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(b"nothing")
    got = sorted((r.path[-6:], r.block_no, r.kind, r.text, r.rows, r.error is None) for r in tables.read_docx(spark, str(tmp_path)).collect())
    assert got == [("a.docx", 0, "paragraph", "One\ttwo", [], True), ("a.docx", 1, "table", "", [["a", "b"]], True), ("a.docx", 2, "paragraph", "", [], True), ("b.docx", None, None, None, None, False)]
    files = spark.createDataFrame([("z", "a.txt", "one", 1), ("z", "a.txt", "two", 2), ("y", "a.txt", "x", 1)], "archive string, name string, content string, order int")
    made = {r.archive: zipfile.ZipFile(io.BytesIO(r.content)) for r in sinks.archives(files).collect()}
    assert {n: z.read(n) for n in made["z"].namelist() for z in [made["z"]]} == {"a.txt": b"one", "a_1.txt": b"two"} and made["y"].namelist() == ["a.txt"]


def test_readers_fall_back_to_plain_text():
    plain = lambda b: ["p1", "p2"]
    assert tables.rich_reader(lambda b: ["r1", " "], plain)(b"") == ["r1", "p2"]
    assert tables.rich_reader(lambda b: 1 / 0, plain)(b"") == ["p1", "p2"]


def test_items_as_json(spark):
    old = '[{"item_type": "table", "rows": [["a", "b"]]}, {"item_type": "heading-1", "font_size": 14, "runs": [{"text": "T", "bold": true}]}, {"text": "old", "italic": true}, {}]'
    once = one(spark, render.items_to_json(render.items_from_json(F.col("s"))), s=old)
    items = one(spark, render.items_from_json(F.col("s")), s=once)
    assert [(i.item_type, i.font_size, i.rows, [tuple(r) for r in i.runs or []]) for i in items] == [("table", None, [["a", "b"]], []), ("heading-1", 14.0, None, [("T", True, False)]), ("body", 11.0, None, [("old", False, True)]), ("body", 11.0, None, [])]


def test_large_groups_are_numbered_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).alias("g"), (F.col("id") * 7919 % 5003).alias("o"), F.lit("x").alias("_range"))
    got = sorted((r.g, r.n, r.o) for r in sequence.numbered(df, ["g"], ["o"]).collect())
    want = []
    for g in (False, True):
        want += [(g, n + 1, o) for n, o in enumerate(sorted(r.o for r in df.where(F.col("g") == g).collect()))]
    assert got == sorted(want)


def test_clashing_columns(spark):
    """Columns that operators add for a while may be there already."""
    df = spark.createDataFrame([(1, 1, "a", "b", "c", 5), (1, 2, "a", "b", "c", 6)], "id int, seq int, _n string, _N_ string, _kept string, v int")
    assert dedup.keep_first(df, ["id"], ["seq"]).first()._n == "a"
    assert dedup.last_wins(df, ["id"], ["seq"], "v")[0].first().v == 6
    assert review.latest(df, ["id"], "seq").first()["_N_"] == "b"
    assert [r._kept for r in sequence.spaced(df, ["id"], "seq", 5).collect()] == ["c"]
    docs = spark.createDataFrame([(1, "READY", "w")], "document_id int, status string, _asked string")
    assert lifecycle.archive(docs, docs).first()._asked == "w"
    text = spark.createDataFrame([("Perfect!", "n", "l")], "line string, _norm string, _low string")
    assert tuple(lines.clean_lines(text).select("_norm", "_low", "kept").first()) == ("n", "l", False)


def test_emphasis_of_blocks(spark):
    run = "array<struct<text:string,bold:boolean,italic:boolean>>"
    r = lambda *ts: [(t, k == 0, False) for k, t in enumerate(ts)]
    ls = spark.createDataFrame([(1, 1, "take more protein daily", r("take more protein daily")), (1, 2, "more protein daily", r("more ", "protein ", "daily")), (1, 3, "fluid", [("fluid", False, False)]), (1, 4, "salt", r("salt"))], f"doc_id int, line_no int, text string, runs {run}")
    bs = spark.createDataFrame([(1, 1, "body", "patients take more protein daily"), (1, 2, "body", "fluid only"), (1, 3, "H1", "salt"), (1, 4, "body", "less salt")], "doc_id int, seq int, tag string, content string")
    assert {x.seq: x.runs and len(x.runs) for x in layout.annotate(bs, ls).collect()} == {1: 3, 2: None, 3: None, 4: 1}


def test_matching_tables_falls_back_to_the_first(spark):
    o = spark.createDataFrame([(1, 1, "t1", ["a", "b"]), (1, 2, "t2", ["c"]), (2, 1, "u", [])], "batch int, table_no int, text string, cells array<string>")
    r = spark.createDataFrame([(1, 1, "x", ["c", "d"]), (1, 2, "t1", ["c"]), (1, 3, "y", ["zz"]), (2, 1, "v", ["a"]), (3, 1, "w", [])], "batch int, table_no int, text string, cells array<string>")
    got = {(x.batch, x.table_no): x.original_no for x in layout.match_tables(r, o, ["batch"]).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (1, 3): 1, (2, 1): 1, (3, 1): None}
