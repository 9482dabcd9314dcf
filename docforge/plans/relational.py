"""Queries over blocks, keys, chunks, versions and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docforge.functions import answers as A
from docforge.functions import rules
from docforge.operators import chapters, dedup, exam, keys, layout, quality, review, sequence
from docforge.plans.registry import LINES_SQL, lines, query
from docforge.sources import sinks
from docforge.sources.tables import page_range, table
from docforge.streaming import events as stream

q = rules.sql_quote
RAW_ANSWER = "CASE p_partkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '3,1' WHEN 2 THEN '2 or 4' WHEN 3 THEN 'Drop' WHEN 4 THEN '?' ELSE '4' END"


@query(
    "q14_sessionise_blocks",
    """WITH g AS (SELECT *, sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events)
    SELECT user_id, CAST(grp AS BIGINT) AS group_no, count(*) AS n, min(event_id) AS first_id, round(sum(value), 4) AS total FROM g WHERE grp > 0 GROUP BY 1, 2""",
)
def q14(spark, sf_dir):
    """Events behind each signup, as blocks behind question headers."""
    rows = sequence.sessionise(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return rows.where("group_no > 0").groupBy("user_id", F.col("group_no").cast("bigint").alias("group_no")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "q15_carry_forward_header",
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""",
)
def q15(spark, sf_dir):
    """The last purchase's value at every event of a user, as pages go on with the last subject."""
    return sequence.carry_forward(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "carried").select("event_id", "carried")


@query(
    "q16_translation_keep_first",
    """WITH b AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS images FROM lineitem),
    s AS (SELECT *, coalesce(max(images) OVER (PARTITION BY l_partkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM b)
    SELECT l_partkey, min(CASE WHEN images = 1 AND NOT seen THEN seq END) AS kept_seq, count(*) FILTER (seen) AS dropped FROM s GROUP BY l_partkey""",
)
def q16(spark, sf_dir):
    """The first line item with images of each part; later ones are translations of it."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_quantity") > 20).cast("int").alias("images"))
    kept, dropped = dedup.translations(rows, [], "l_partkey")
    n = dropped.groupBy("l_partkey").agg(F.count("*").alias("dropped"))
    return rows.select("l_partkey").distinct().join(kept.select("l_partkey", F.col("seq").alias("kept_seq")), "l_partkey", "left").join(n, "l_partkey", "left").select("l_partkey", "kept_seq", F.coalesce("dropped", F.lit(0).cast("bigint")).alias("dropped"))


@query(
    "q17_answer_classification",
    f"""WITH r AS (SELECT p_partkey, {RAW_ANSWER} AS raw FROM part),
    k AS (SELECT raw, CASE raw WHEN '1' THEN 'single' WHEN '4' THEN 'single' WHEN '3,1' THEN 'multi' WHEN '2 or 4' THEN 'or' WHEN 'Drop' THEN 'drop' ELSE 'unknown' END AS kind,
                 CASE raw WHEN '3,1' THEN 'Correct Options: 1, 3  (multiple correct)' WHEN '2 or 4' THEN 'Correct Option: 2 or 4  (either accepted)' WHEN 'Drop' THEN '{A.DROPPED}' WHEN '?' THEN 'Answer (raw): ?' ELSE 'Correct Option: ' || raw END AS shown FROM r)
    SELECT kind, shown, count(*) AS n FROM k GROUP BY 1, 2""",
)
def q17(spark, sf_dir):
    """Kinds of answers, and how they are shown."""
    a = A.classify(F.expr(RAW_ANSWER))
    return table(spark, sf_dir, "part").select(a.alias("a")).select("a.kind", A.show(F.col("a")).alias("shown")).groupBy("kind", "shown").agg(F.count("*").alias("n"))


@query(
    "q18_answer_key_parse",
    f"""WITH r AS (SELECT p_partkey, p_partkey // 50 AS page, {RAW_ANSWER} AS raw FROM part)
    SELECT CAST(page AS BIGINT) AS page_num, '7' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS question_id, CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE raw END AS raw, CAST(100 + page - page % 4 AS VARCHAR) AS subject_code FROM r""",
)
def q18(spark, sf_dir):
    """Pages of tokens of fifty parts each; every fourth page has a subject, some ids no answer."""
    token = F.concat(F.lit("7"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.when(F.col("p_partkey") % 9 == 4, "").otherwise(F.concat(F.lit("\n"), F.expr(RAW_ANSWER))))
    page = F.floor(F.col("p_partkey") / 50).cast("bigint")
    head = F.when(F.col("page_num") % 4 == 0, F.concat(F.lit("Subject: ("), (100 + F.col("page_num")).cast("string"), F.lit(") LIFE SCIENCES\n"))).otherwise("")
    rows = table(spark, sf_dir, "part").select(page.alias("page_num"), "p_partkey", token.alias("t"))
    pages = rows.groupBy("page_num").agg(sinks.ordered_text(F.col("p_partkey"), F.col("t"), "\n").alias("body")).select((F.col("page_num") - F.col("page_num") % 4).alias("doc_id"), "page_num", F.concat(head, F.lit("Question ID    Correct Option No.\n"), F.col("body")).alias("text"))
    return keys.pair_long_ids(pages).select("page_num", "question_id", "raw", F.col("subject.code").alias("subject_code"))


@query(
    "q19_question_answer_left_join",
    """SELECT o_orderpriority, count(*) AS questions, count(c.c_custkey) AS matched, CAST(count(*) FILTER (c.c_custkey IS NULL) AS BIGINT) AS missing
    FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_acctbal > 0 GROUP BY 1""",
)
def q19(spark, sf_dir):
    """Orders as questions, customers in credit as answers. The answer side has one row an id."""
    questions = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("q_id"), "o_orderpriority")
    answers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("question_id"), F.lit("x").alias("answer"))
    return exam.with_answers(questions, answers).groupBy("o_orderpriority").agg(F.count("*").alias("questions"), F.count_if("found").alias("matched"), F.count_if(~F.col("found")).alias("missing"))


@query(
    "q20_matched_missing_extra",
    """SELECT 'matched' AS part, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'missing', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'extra', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""",
)
def q20(spark, sf_dir):
    """Documents with and without a label, labels without a document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    parts = exam.matched_missing_extra(docs, labels, "doc_id")
    made = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, p in zip(("matched", "missing", "extra"), parts)]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(
    "q21_best_overlap_subject",
    """WITH q AS (SELECT DISTINCT p_partkey FROM part WHERE p_size <= 10),
    h AS (SELECT s_nationkey AS subject, count(DISTINCT l_partkey) AS overlap FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT p_partkey FROM q) GROUP BY 1),
    e AS (SELECT DISTINCT s_nationkey AS subject FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    c AS (SELECT e.subject, coalesce(h.overlap, 0) AS overlap FROM e LEFT JOIN h ON h.subject = e.subject)
    SELECT subject, CAST(overlap AS BIGINT) AS overlap, row_number() OVER (ORDER BY overlap DESC, subject) = 1 AND overlap > 0 AS best FROM c""",
)
def q21(spark, sf_dir):
    """Nations of suppliers as subjects: which answers most of the small parts."""
    ids = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("q_id"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("subject"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("q_id"), "l_suppkey").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select("q_id", "subject", F.col("subject").alias("subject_order"))
    return exam.best_subject(ids, rows).select("subject", "overlap", "best")


@query(
    "q22_option_id_resolution",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Correct Option: 3' WHEN 1 THEN 'Correct Options: 1, 4  (multiple correct)' WHEN 2 THEN 'Correct Option: 2'
       ELSE 'Answer key references unknown Option ID: 9 (raw: 9)' END AS answer_text, TRUE AS found FROM part""",
)
def q22(spark, sf_dir):
    """Option ids of each part's key looked up among its own options."""
    base = F.col("p_partkey") * 10
    options = F.array(*[F.struct(F.lit(n).alias("number"), (base + n).cast("string").alias("option_id")) for n in (1, 2, 3, 4)])
    s = lambda n: (base + n).cast("string")
    raw = F.when(F.col("p_partkey") % 4 == 0, s(3)).when(F.col("p_partkey") % 4 == 1, F.concat(s(4), F.lit(", "), s(1))).when(F.col("p_partkey") % 4 == 2, F.lit("2")).otherwise(F.lit("9"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), F.when(F.col("p_partkey") % 4 == 1, "multi").otherwise("single").alias("kind"), options.alias("options"))
    return exam.resolve_answers(rows).select("p_partkey", "answer_text", "found")


@query(
    "q23_option_parse",
    """SELECT p_partkey, 1 AS number, p_name AS text, CAST(p_partkey AS VARCHAR) AS option_id FROM part UNION ALL SELECT p_partkey, 2, p_brand, NULL FROM part""",
)
def q23(spark, sf_dir):
    """Options out of a printed text, one with its id, one without."""
    text = F.concat(F.lit("1. "), "p_name", F.lit(" [Option ID = "), F.col("p_partkey").cast("string"), F.lit("]\n2. "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(exam.options_of(text)))


@query(
    "q24_duplicate_last_wins_log",
    """WITH o AS (SELECT user_id, event_type, value, lag(value) OVER w AS prev, row_number() OVER w AS rn, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS last FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT user_id, event_type, max(CASE WHEN last = 1 THEN value END) AS value, count(*) FILTER (rn > 1) AS overwritten, round(coalesce(sum(abs(value - prev)), 0), 4) AS moved FROM o GROUP BY 1, 2""",
)
def q24(spark, sf_dir):
    """The last value of each key, and the log of overwritings."""
    last, log = dedup.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"], "value")
    n = log.groupBy("user_id", "event_type").agg(F.count("*").alias("overwritten"), F.sum(F.abs(F.col("new") - F.col("prev"))).alias("moved"))
    return last.select("user_id", "event_type", "value").join(n, ["user_id", "event_type"], "left").select("user_id", "event_type", "value", F.coalesce("overwritten", F.lit(0).cast("bigint")).alias("overwritten"), F.round(F.coalesce("moved", F.lit(0.0)), 4).alias("moved"))


@query(
    "q25_page_chunk_range_join",
    """WITH p AS (SELECT source, doc_id AS page, n_chars FROM documents), r AS (SELECT source, min(page) AS a, max(page) AS b FROM p GROUP BY source),
    c AS (SELECT source, unnest(range(a, b + 1, 250)) AS s, b FROM r)
    SELECT p.source, (p.page - r.a) // 250 + 1 AS chunk_index, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars FROM p JOIN r ON r.source = p.source
    WHERE EXISTS (SELECT 1 FROM c WHERE c.source = p.source AND p.page BETWEEN c.s AND least(c.s + 249, c.b)) GROUP BY 1, 2""",
)
def q25(spark, sf_dir):
    """Documents as pages of their source, in chunks of 250 page numbers."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_num"), "n_chars")
    ends = pages.groupBy("doc_id").agg(F.min("page_num").alias("a"), F.max("page_num").alias("b"))
    chunks = ends.select("doc_id", F.posexplode(F.sequence("a", "b", F.lit(250).cast("bigint"))).alias("k", "page_start"), "b").select("doc_id", (F.col("k") + 1).cast("bigint").alias("chunk_index"), "page_start", F.least(F.col("page_start") + 249, F.col("b")).alias("page_end"))
    return chapters.chunk_of_page(pages, chunks).where("chunk_index IS NOT NULL").groupBy(F.col("doc_id").alias("source"), "chunk_index").agg(F.count("*").alias("pages"), F.sum("n_chars").cast("bigint").alias("chars"))


@query(
    "q26_rect_overlap_anti",
    """WITH b AS (SELECT p_partkey, p_partkey // 40 AS page, (p_partkey % 8) * 60.0 AS x0, (p_partkey % 5) * 90.0 AS y0 FROM part),
    t AS (SELECT page, x0 + 30 AS x0, y0 + 40 AS y0, x0 + 90 AS x1, y0 + 100 AS y1 FROM b WHERE p_partkey % 10 = 3)
    SELECT p_partkey FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND b.x0 < t.x1 AND t.x0 < b.x0 + 50 AND b.y0 < t.y1 AND t.y0 < b.y0 + 50)""",
)
def q26(spark, sf_dir):
    """Blocks that lie outside all tables of their page."""
    k = F.col("p_partkey")
    blocks = table(spark, sf_dir, "part").select(k, F.floor(k / 40).alias("page"), ((k % 8) * 60.0).alias("x0"), ((k % 5) * 90.0).alias("y0"))
    tables = blocks.where(k % 10 == 3).select("page", (F.col("x0") + 30).alias("x0"), (F.col("y0") + 40).alias("y0"), (F.col("x0") + 90).alias("x1"), (F.col("y0") + 100).alias("y1"))
    return layout.outside_tables(blocks.withColumn("x1", F.col("x0") + 50).withColumn("y1", F.col("y0") + 50), tables, ["page"]).select("p_partkey")


@query(
    "q27_upper_vs_avg_median",
    """SELECT p_brand, CAST(list_sort(list(p_size))[count(*) // 2 + 1] AS DOUBLE) AS upper_median, CAST(median(p_size) AS DOUBLE) AS average_median, CAST(max(p_size) AS BIGINT) AS dominant FROM part GROUP BY 1""",
)
def q27(spark, sf_dir):
    """Two medians of sizes: chapters go by the upper one, lines by the mean one."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(layout.upper_median("p_size").alias("upper_median"), layout.average_median(F.col("p_size").cast("double")).alias("average_median"), F.max("p_size").cast("bigint").alias("dominant"))


SPANS = """SELECT doc_id, line_no // 8 + 1 AS page_num, line_no AS seq, CASE WHEN line_no % 16 = 0 THEN 'Chapter ' || CAST(line_no // 16 + 1 AS VARCHAR) || ' ' || line ELSE line END AS text,
    CASE WHEN line_no % 16 = 9 THEN 14.0 ELSE 10.0 END AS size, (line_no % 8) * 100.0 AS y0 FROM lines"""


def _spans(spark, sf_dir):
    n = F.col("line_no")
    return lines(spark, sf_dir).select("doc_id", (F.floor(n / 8) + 1).alias("page_num"), n.alias("seq"), F.when(n % 16 == 0, F.concat(F.lit("Chapter "), (F.floor(n / 16) + 1).cast("string"), F.lit(" "), "line")).otherwise(F.col("line")).alias("text"), F.when(n % 16 == 9, 14.0).otherwise(10.0).alias("size"), ((n % 8) * 100.0).alias("y0"), F.lit(842.0).alias("page_height"))


SQL_BOUNDS = f"""{LINES_SQL}, spans AS ({SPANS}), last AS (SELECT doc_id, max(page_num) AS last, min(page_num) AS first FROM spans GROUP BY 1),
    m AS (SELECT s.doc_id, list_sort(list(size))[count(*) // 2 + 1] AS median FROM spans s JOIN last l ON l.doc_id = s.doc_id
          WHERE (page_num - 1) % greatest(last // 20, 1) = 0 AND length(trim(text)) > 3 AND size > 0 GROUP BY 1),
    k AS (SELECT s.*, CASE WHEN regexp_matches(text, {q(rules.CHAPTER)}) THEN 0.95 WHEN y0 / 842 < 0.4 AND size / coalesce(median, 12.0) >= 1.3 THEN 0.70 END AS confidence FROM spans s LEFT JOIN m ON m.doc_id = s.doc_id),
    b AS (SELECT doc_id, page_num AS page, trim(text) AS title, CAST(confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY confidence DESC, seq) AS rn FROM k WHERE confidence >= 0.6)"""


@query("q28_chapter_boundaries", f"WITH {SQL_BOUNDS} SELECT doc_id, page, title, confidence FROM b WHERE rn = 1")
def q28(spark, sf_dir):
    """Chapter starts by words and by size, the surest of each page."""
    return chapters.boundaries(_spans(spark, sf_dir)).select("doc_id", "page", "title", F.col("confidence").cast("double").alias("confidence"))


@query(
    "q29_chapter_ends_preamble",
    f"""WITH {SQL_BOUNDS}, o AS (SELECT b.doc_id, page, title, last, first FROM b JOIN last ON last.doc_id = b.doc_id WHERE rn = 1 AND page > 1),
    e AS (SELECT doc_id, page AS page_start, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, last) AS page_end, title FROM o)
    SELECT doc_id, page_start, page_end, title FROM e UNION ALL SELECT doc_id, min(first), min(page) - 1, 'Preamble' FROM o GROUP BY doc_id HAVING min(page) > min(first)""",
)
def q29(spark, sf_dir):
    """Chapters with their ends, and a preamble; starts on a first page are left out so that there is one."""
    spans = _spans(spark, sf_dir)
    starts = chapters.boundaries(spans).where("page > 1")
    return chapters.ranges(starts, spans.select("doc_id", "page_num"))


@query(
    "q30_greedy_chunk_pack",
    """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    b(source, k, doc_id, bin, used) AS (SELECT source, k, doc_id, 0, n_chars FROM d WHERE k = 1
      UNION ALL SELECT d.source, d.k, d.doc_id, CASE WHEN b.used + d.n_chars > 20000 THEN b.bin + 1 ELSE b.bin END, CASE WHEN b.used + d.n_chars > 20000 THEN d.n_chars ELSE b.used + d.n_chars END
                FROM b JOIN d ON d.source = b.source AND d.k = b.k + 1)
    SELECT doc_id, CAST(bin AS BIGINT) AS bin FROM b""",
)
def q30(spark, sf_dir):
    """Documents of a source in chunks of 20,000 characters at most, in order. The fold holds ids and sizes, no text."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return sequence.pack(rows, ["source"], "doc_id", "n_chars", 20000).select("doc_id", F.col("bin").cast("bigint").alias("bin"))


@query(
    "q32_neighbour_context",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN text END AS t FROM conversations)
    SELECT conv_id, turn, substr(coalesce(string_agg(t, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ''), 1, 1000) AS before,
           substr(coalesce(string_agg(t, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ''), 1, 1000) AS after FROM c""",
)
def q32(spark, sf_dir):
    """Two turns before and after each turn, without system turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return sequence.neighbours(rows, ["conv_id"], "turn", "text", F.col("role") == "system").select("conv_id", "turn", "before", "after")


@query(
    "q34_latest_draft_queue",
    """WITH d AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    SELECT o_custkey AS document_id, l_orderkey AS draft_id, l_linenumber AS section_no, c_mktsegment AS chunk_status FROM lineitem JOIN d ON d.o_orderkey = l_orderkey AND rn = 1
    LEFT JOIN customer ON c_custkey = l_suppkey WHERE l_returnflag <> 'A'""",
)
def q34(spark, sf_dir):
    """Sections of every document's newest draft that await review: orders as drafts, line items as sections."""
    drafts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("draft_id"), F.col("o_orderdate").alias("created_at"))
    sections = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("section_no"), F.when(F.col("l_returnflag") == "A", "APPROVED").otherwise("PENDING").alias("status"), F.col("l_suppkey").alias("chunk_id"))
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_mktsegment").alias("status"))
    return review.review_queue(drafts, sections, chunks).select("document_id", "draft_id", "section_no", "chunk_status")


@query(
    "q35_current_version",
    """WITH n AS (SELECT conv_id, turn, md5(text) AS text_md5, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'assistant' DESC, turn DESC) AS rn FROM conversations)
    SELECT conv_id, turn AS version, text_md5 FROM n WHERE rn = 1""",
)
def q35(spark, sf_dir):
    """Turns as versions, the assistant's as edited ones."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").alias("version"), (F.col("role") == "assistant").alias("is_edited"), F.md5("text").alias("text_md5"))
    return review.current_version(rows).select(F.col("section_id").alias("conv_id"), "version", "text_md5")


@query(
    "q36_status_rollups",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS total FROM orders GROUP BY 1""",
)
def q36(spark, sf_dir):
    """Counts by status."""
    return review.rollup(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query(
    "q37_list_documents_page",
    """SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE upper(o_orderstatus) = 'O' AND o_orderpriority ILIKE '%high%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100""",
)
def q37(spark, sf_dir):
    """The third page of a filtered listing, with the count of all."""
    rows = table(spark, sf_dir, "orders").where(review.status_is(F.col("o_orderstatus"), "o") & review.matches(F.col("o_orderpriority"), "high"))
    return review.page_of(rows.select("o_orderkey", "o_totalprice", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 100, 50).select("o_orderkey", "o_totalprice", "total")


@query(
    "q38_user_order_with_fallback",
    """WITH w AS (SELECT n_nationkey, 24 - n_nationkey AS pos FROM nation WHERE n_nationkey % 3 = 0)
    SELECT n.n_nationkey, row_number() OVER (ORDER BY w.pos IS NULL, w.pos, n.n_name, n.n_nationkey) AS position FROM nation n LEFT JOIN w ON w.n_nationkey = n.n_nationkey""",
)
def q38(spark, sf_dir):
    """Nations a user has put in order first, the others by name."""
    nation = table(spark, sf_dir, "nation")
    wanted = nation.where("n_nationkey % 3 = 0").select("n_nationkey", (24 - F.col("n_nationkey")).alias("pos"))
    return review.in_order_of(nation, wanted, "n_nationkey", "pos", "n_name").select("n_nationkey", F.col("position").cast("bigint").alias("position"))


@query(
    "q39_merge_gate",
    """SELECT l_orderkey AS doc_id, count(*) FILTER (l_linestatus <> 'F') AS incomplete, count(*) FILTER (l_linestatus = 'F' AND l_quantity < 5) AS without_output, count(*) FILTER (l_quantity >= 5) AS parts,
       count(*) FILTER (l_linestatus <> 'F') = 0 AND count(*) FILTER (l_linestatus = 'F' AND l_quantity < 5) = 0 AND count(*) FILTER (l_quantity >= 5) >= 1 AS ok FROM lineitem GROUP BY 1""",
)
def q39(spark, sf_dir):
    """Which orders could be merged: all items complete, each with its output."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linestatus") == "F", "COMPLETED").otherwise("PENDING").alias("status"), F.when(F.col("l_quantity") >= 5, "file").alias("output"))
    return review.merge_gate(rows)


@query(
    "q40_record_validators",
    """WITH v AS (SELECT page_id, length(url) BETWEEN 1 AND 40 AS a, coalesce(starts_with(url, 'https://'), FALSE) AS b, length(html) <= 4000 AS c FROM pages)
    SELECT page_id, 'url_length' AS rule FROM v WHERE coalesce(NOT a, TRUE) UNION ALL SELECT page_id, 'url_scheme' FROM v WHERE NOT b UNION ALL SELECT page_id, 'html_length' FROM v WHERE coalesce(NOT c, TRUE)""",
)
def q40(spark, sf_dir):
    """Rules that pages break."""
    rules_now = {"url_length": quality.length_within(F.col("url"), 1, 40), "url_scheme": F.col("url").startswith("https://"), "html_length": F.length("html") <= 4000}
    return quality.violations(table(spark, sf_dir, "pages"), "page_id", rules_now)


@query("q45_collision_suffix", "SELECT doc_id, CASE WHEN row_number() OVER w > 1 THEN source || '_' || CAST(row_number() OVER w - 1 AS VARCHAR) || '.txt' ELSE source || '.txt' END AS archive_name FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def q45(spark, sf_dir):
    """File names in an archive: every source's second and later ones get a number."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("name"))
    return sinks.unique_names(rows, "name", "doc_id").select("doc_id", "archive_name")


ACTION = "CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'approve' WHEN 'purchase' THEN 'lock' WHEN 'error' THEN 'flag' ELSE 'unlock' END"


@query(
    "q49_review_state_fold",
    f"""WITH RECURSIVE a AS (SELECT user_id, {ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s(user_id, k, status, flagged) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'PENDING', FALSE FROM a
      UNION ALL SELECT a.user_id, a.k, CASE WHEN s.status = 'LOCKED' AND a.action <> 'unlock' THEN s.status WHEN a.action = 'approve' THEN 'APPROVED' WHEN a.action = 'lock' THEN 'LOCKED' ELSE 'REVIEWED' END,
                       CASE WHEN s.status = 'LOCKED' AND a.action <> 'unlock' THEN s.flagged WHEN a.action = 'flag' THEN TRUE WHEN a.action = 'approve' THEN FALSE ELSE s.flagged END
                FROM s JOIN a ON a.user_id = s.user_id AND a.k = s.k + 1)
    SELECT user_id, arg_max(status, k) AS status, arg_max(flagged, k) AS flagged FROM s GROUP BY user_id""",
)
def q49(spark, sf_dir):
    """Events as review actions: the state each user's section ends in."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(ACTION).alias("action"))
    return review.review_state(rows, ["user_id"], ["ts", "event_id"])


@query(
    "q50_event_log_windows",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def q50(spark, sf_dir):
    """Hourly counts; the same function runs on a stream."""
    return stream.windowed_counts(table(spark, sf_dir, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "q51_chunk_json",
    """WITH k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id >= 1 AND length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) > 0)
    SELECT source, CAST((n - 1) // 50 + 1 AS BIGINT) AS chunk_index, count(*) AS pages, min(doc_id) AS first_page, max(doc_id) AS last_page FROM k GROUP BY 1, 2""",
)
def q51(spark, sf_dir):
    """Kept pages of each source fifty to a chunk, written to and read from JSON."""
    pages = page_range(table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_num"), "text"))
    made = sinks.chunk_json(pages, 50)
    read = made.select("doc_id", F.from_json("json", "chunk_index int, pages array<struct<page_num:bigint,text:string>>", {"maxStringLen": str(2**31 - 1)}).alias("j"))
    nums = F.transform("j.pages", lambda p: p["page_num"])
    return read.select(F.col("doc_id").alias("source"), F.col("j.chunk_index").cast("bigint").alias("chunk_index"), F.size("j.pages").cast("bigint").alias("pages"), F.array_min(nums).alias("first_page"), F.array_max(nums).alias("last_page"))


def objective_blocks(spark, sf_dir):
    """Blocks of objective papers: a marker, page chrome, number with id, then images, for each order."""
    o = table(spark, sf_dir, "orders")
    block = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(1).alias("xref"))
    qid = F.concat(F.lit("7"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    stream_of = F.concat(F.array(block("text", F.lit("Objective Question")), block("text", F.lit("Page 3 of 9")), block("text", F.concat(F.lit("12 "), qid))), F.array_repeat(block("image", F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return o.select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.posexplode(stream_of).alias("k", "b")).select("doc_id", (F.col("o_orderkey") * 10 + F.col("k")).alias("seq"), "b.kind", "b.text", "b.xref")


@query(
    "q52_objective_questions",
    """SELECT o_custkey AS doc_id, '7' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS q_id, 1 + CAST(o_orderkey % 3 AS BIGINT) AS images,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q_num FROM orders""",
)
def q52(spark, sf_dir):
    """Objective questions out of a block stream: a marker, page chrome, number with id, then images. Ids have seven digits:
    the last six of the order's key, whatever its size; blocks go by the whole key."""
    rows = objective_blocks(spark, sf_dir)
    return exam.group_objective_questions(rows).select("doc_id", "q_id", F.size("images").cast("bigint").alias("images"), F.col("q_num").cast("bigint").alias("q_num"))


@query(
    "q53_spaced_contents",
    """WITH RECURSIVE d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    s(source, k, doc_id, kept) AS (SELECT source, k, doc_id, doc_id FROM d WHERE k = 1
      UNION ALL SELECT d.source, d.k, d.doc_id, CASE WHEN d.doc_id - s.kept >= 45 THEN d.doc_id ELSE s.kept END FROM s JOIN d ON d.source = s.source AND d.k = s.k + 1)
    SELECT source, doc_id FROM s WHERE kept = doc_id""",
)
def q53(spark, sf_dir):
    """Entries at least 45 apart from the last kept one."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id")
    return sequence.spaced(rows, ["source"], "doc_id", 45)


@query(
    "q54_safe_cuts",
    """WITH p AS (SELECT 1 AS doc_id, CAST(p_partkey AS BIGINT) AS page_num, p_size % 3 = 0 AS t FROM part),
    c AS (SELECT page_num, t AND coalesce(lag(t) OVER (ORDER BY page_num), FALSE) AS continues FROM p)
    SELECT a.page_num AS cut, coalesce((SELECT min(page_num) FROM c WHERE c.page_num >= a.page_num AND (NOT c.continues OR c.page_num % 40 = 0)), a.page_num) AS safe FROM c a WHERE a.page_num % 10 = 0""",
)
def q54(spark, sf_dir):
    """Cuts every ten pages, moved past pages that go on with a table."""
    k = F.col("p_partkey").cast("bigint")
    pages = table(spark, sf_dir, "part").select(F.floor(k / 2_000_000).alias("doc_id"), k.alias("page_num"), F.when(F.col("p_size") % 3 == 0, "| a | b |\n| c | d |").otherwise("plain text").alias("text"))
    cuts = pages.where("page_num % 10 = 0").select("doc_id", F.col("page_num").alias("cut"))
    starts = pages.where("page_num % 40 = 0").select("doc_id", F.col("page_num").alias("page"))
    return chapters.safe_cuts(pages, cuts, starts).select("cut", "safe")


@query(
    "q55_key_warnings",
    f"""WITH r AS (SELECT p_brand AS subject, {RAW_ANSWER} AS raw, p_partkey FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY subject, p_partkey % 100 ORDER BY p_partkey) AS rn FROM r)
    SELECT subject, count(*) AS entries, count(*) FILTER (raw = '?') AS unrecognised, count(*) FILTER (rn > 1) AS duplicates FROM n GROUP BY 1""",
)
def q55(spark, sf_dir):
    """Entries, unrecognised and overwritten ones of each subject."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("subject"), (F.col("p_partkey") % 100).alias("question_id"), F.expr(RAW_ANSWER).alias("raw"), "p_partkey")
    entries = rows.withColumn("kind", A.classify(F.col("raw"))["kind"])
    _, log = dedup.last_wins(rows, ["subject", "question_id"], ["p_partkey"], "raw")
    return keys.warnings(entries, log).select("subject", "entries", "unrecognised", "duplicates")


@query(
    "q56_system_health",
    """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS processing, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS failed, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS ready,
       (SELECT count(*) FROM lineitem) AS chunks, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS failed_chunks""",
)
def q56(spark, sf_dir):
    """System counts, orders as documents and line items as chunks."""
    names = F.when(F.col("o_orderstatus") == "P", "PROCESSING").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("READY")
    docs = table(spark, sf_dir, "orders").select(names.alias("status"))
    chunks = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("COMPLETED").alias("status"))
    return review.health(docs, chunks, ["READY"])


@query(
    "q57_chapter_packing",
    """WITH RECURSIVE e AS (SELECT source, doc_id AS page_start, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) - 1, doc_id) AS page_end, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    p AS (SELECT source, k, page_start + i AS a, least(page_start + i + 59, page_end) AS b FROM e, unnest(range(0, page_end - page_start + 1, 60)) AS t(i)),
    o AS (SELECT *, b - a + 1 AS n, row_number() OVER (PARTITION BY source ORDER BY a) AS r FROM p),
    s(source, r, a, b, bin, used) AS (SELECT source, r, a, b, 1, n FROM o WHERE r = 1
      UNION ALL SELECT o.source, o.r, o.a, o.b, CASE WHEN s.used + o.n > 60 THEN s.bin + 1 ELSE s.bin END, CASE WHEN s.used + o.n > 60 THEN o.n ELSE s.used + o.n END FROM s JOIN o ON o.source = s.source AND o.r = s.r + 1)
    SELECT source, CAST(bin AS BIGINT) AS chunk_index, min(a) AS page_start, max(b) AS page_end FROM s GROUP BY 1, 2""",
)
def q57(spark, sf_dir):
    """Documents of a source as chapters between their ids, packed into chunks of 60 pages, long ones split."""
    w = Window.partitionBy("source").orderBy("doc_id")
    parts = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_start"), F.coalesce(F.lead("doc_id").over(w) - 1, F.col("doc_id")).alias("page_end"), F.lit("t").alias("title"))
    return chapters.pack_chapters(parts, 60).select(F.col("doc_id").alias("source"), F.col("chunk_index").cast("bigint").alias("chunk_index"), "page_start", "page_end")
