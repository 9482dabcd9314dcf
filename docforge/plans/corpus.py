"""Queries over document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from docforge.functions import render, rules, stages
from docforge.functions import text as T
from docforge.operators import assembly, dedup, models, sequence
from docforge.operators import lines as L
from docforge.plans.registry import ENRICHED_SQL, LINES_SQL, enriched, lines, query
from docforge.sources.tables import spread, table

q = rules.sql_quote


@query(
    "q01_clean_corpus_summary",
    f"""WITH {LINES_SQL}, n AS (SELECT lang, {T.sql_normalize_line("line")} AS norm FROM lines),
    k AS (SELECT lang, norm, norm <> '' AND {rules.sql_rule_of("norm")} IS NULL AS kept FROM n)
    SELECT lang, count(*) AS n_lines, CAST(count(*) FILTER (kept) AS BIGINT) AS kept, CAST(count(*) FILTER (NOT kept) AS BIGINT) AS dropped,
           CAST(coalesce(sum(CASE WHEN kept THEN length({T.sql_split_fused("norm")}) END), 0) AS BIGINT) AS kept_chars FROM k GROUP BY lang""",
)
def q01(spark, sf_dir):
    """Lines cleaned, by language: how many stay, and their characters."""
    rows = L.clean_lines(lines(spark, sf_dir).select("lang", "line"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.coalesce(F.sum(F.when(F.col("kept"), F.length("clean"))), F.lit(0)).cast("bigint").alias("kept_chars"))


@query(
    "q02_pii_redaction_audit",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(text, {q(T.EMAIL)})) AS BIGINT) AS n_emails, CAST(length(text) AS BIGINT) AS chars,
        CAST(length({T.sql_redact("text")}) AS BIGINT) AS redacted_chars, md5({T.sql_redact("text")}) AS redacted_md5
        FROM documents WHERE text IS NOT NULL""",
)
def q02(spark, sf_dir):
    """Documents before and after redaction."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    safe = T.redact(F.col("text"))
    return docs.select("doc_id", F.regexp_count("text", F.lit(T.EMAIL)).cast("bigint").alias("n_emails"), F.length("text").cast("bigint").alias("chars"), F.length(safe).cast("bigint").alias("redacted_chars"), F.md5(safe).alias("redacted_md5"))


@query("q03_rule_hit_histogram", f"WITH {ENRICHED_SQL}, r AS (SELECT {rules.sql_rule_of('line')} AS rule FROM enriched) SELECT coalesce(rule, 'kept') AS rule, count(*) AS n FROM r GROUP BY 1")
def q03(spark, sf_dir):
    """How often each rule drops a line."""
    return enriched(spark, sf_dir).select(F.coalesce(rules.rule_of(F.col("line")), F.lit("kept")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "q04_chat_artifact_filter",
    f"""WITH l AS (SELECT conv_id, turn, role, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE text IS NOT NULL),
    e AS (SELECT role, CASE WHEN line_no % 3 = 1 THEN 'Assistant: ' || line WHEN line_no % 5 = 2 THEN 'Sure, here is ' || line WHEN line_no % 7 = 3 THEN 'Yess!!' ELSE line END AS line FROM l)
    SELECT role, count(*) AS n_lines, CAST(count(*) FILTER ({rules.sql_rule_of("line")} IS NOT NULL) AS BIGINT) AS dropped,
           CAST(count(*) FILTER (regexp_matches(trim(line), {q(rules.SPEAKER)})) AS BIGINT) AS speaker_labels,
           CAST(count(*) FILTER (regexp_matches(trim(line), {q(rules.OPENER)})) AS BIGINT) AS openers FROM e GROUP BY role""",
)
def q04(spark, sf_dir):
    """Chat artefacts by role."""
    rows = sequence.lines_of(table(spark, sf_dir, "conversations").select("role", "text")).withColumn("line", F.expr("CASE WHEN line_no % 3 = 1 THEN 'Assistant: ' || line WHEN line_no % 5 = 2 THEN 'Sure, here is ' || line WHEN line_no % 7 = 3 THEN 'Yess!!' ELSE line END"))
    s = F.trim("line")
    return rows.groupBy("role").agg(F.count("*").alias("n_lines"), F.count_if(rules.should_drop(F.col("line"))).alias("dropped"), F.count_if(s.rlike(rules.SPEAKER)).alias("speaker_labels"), F.count_if(s.rlike(rules.OPENER)).alias("openers"))


@query(
    "q05_sentence_drop_chain",
    rf"""WITH {LINES_SQL}, x AS (SELECT doc_id, line_no, line FROM lines WHERE NOT regexp_matches(line, '^\s*\d{{1,2}}\.\s*$')),
    s AS (SELECT doc_id, line_no, unnest({T.sql_sentences("line")}) AS sentence, generate_subscripts({T.sql_sentences("line")}, 1) AS k FROM x),
    j AS (SELECT doc_id, line_no, string_agg(sentence, ' ' ORDER BY k) AS line FROM s WHERE NOT regexp_matches(sentence, '(?i)^(the|der|la) ') GROUP BY doc_id, line_no),
    t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM j WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id)
    SELECT d.doc_id, CAST(length(coalesce(t.text, '')) AS BIGINT) AS chars, md5(coalesce(t.text, '')) AS text_md5 FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id WHERE d.text IS NOT NULL""",
)
def q05(spark, sf_dir):
    """A stage of the drop chain: lone numbers go as lines, sentences that begin with an article go."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    out = L.drop_chain(docs, [{"line": rules.LONE_NUMBER, "sentence": r"(?i)^(the|der|la) "}])
    return out.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("text_md5"))


#: Lines of documents with talk about making a book between them.
TALKED = """CASE line_no % 9 WHEN 1 THEN 'Ready for next step: ' || line WHEN 2 THEN line || ' This is awesome. ' || line WHEN 3 THEN line || ' See here''s how it goes! Salt stays.'
 WHEN 4 THEN 'Laminate it ' || line WHEN 5 THEN line || ' A  premium edition of it! Rice stays.' WHEN 6 THEN 'Professional toolkit ' || line WHEN 7 THEN '***'
 WHEN 8 THEN line || ' Do you want more? Keep this.' ELSE line END"""


@query(
    "q93_finished_books",
    f"WITH {LINES_SQL}, s0 AS (SELECT doc_id, line_no, {TALKED} AS text FROM lines), "
    + ", ".join(f"s{i + 1} AS (SELECT doc_id, line_no, text FROM (SELECT doc_id, line_no, {stages.sql_finished('text', stage)} AS text FROM s{i}) WHERE text IS NOT NULL)" for i, stage in enumerate(stages.STAGES))
    + " SELECT doc_id, line_no, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM s5",
)
def q93(spark, sf_dir):
    """Every line of all documents as a paragraph, through the five stages by which a book is finished."""
    said = lines(spark, sf_dir).select("doc_id", "line_no", F.expr(TALKED).alias("text"))
    return L.finish_book(said).select("doc_id", "line_no", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("text_md5"))


@query("q06_line_type_tagging", f"WITH {ENRICHED_SQL} SELECT lang, {rules.sql_tag_of('line')} AS tag, count(*) AS n FROM enriched WHERE trim(line) <> '' GROUP BY 1, 2")
def q06(spark, sf_dir):
    """Tags of lines, by language."""
    return enriched(spark, sf_dir).where(F.trim("line") != "").select("lang", rules.tag_of(F.col("line")).alias("tag")).groupBy("lang", "tag").agg(F.count("*").alias("n"))


@query(
    "q07_block_tags_and_runs",
    f"""WITH {ENRICHED_SQL}, f AS (SELECT *, CASE WHEN line_no % 29 IN (14, 18) THEN '```' ELSE line END AS l2 FROM enriched),
    g AS (SELECT *, sum(CAST(regexp_matches(l2, '^\\s*```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM f),
    t AS (SELECT doc_id, line_no, fences, fences % 2 = 1 AS code, CASE WHEN fences % 2 = 1 THEN 'code' WHEN trim(l2) = '' THEN 'blank' ELSE {rules.sql_tag_of("l2")} END AS tag,
                 CASE WHEN fences % 2 = 1 THEN rtrim(l2) ELSE trim(l2) END AS text FROM g WHERE NOT regexp_matches(l2, '^\\s*```')),
    r AS (SELECT *, CASE WHEN tag IN ('table', 'code') AND tag = lag(tag) OVER w AND fences = lag(fences) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM r),
    m AS (SELECT doc_id, run, min(tag) AS tag, string_agg(text, chr(10) ORDER BY line_no) AS content FROM b WHERE tag <> 'blank' GROUP BY doc_id, run),
    x AS (SELECT *, CASE WHEN tag = 'body' AND tag = lag(tag) OVER (PARTITION BY doc_id ORDER BY run) THEN 0 ELSE 1 END AS new FROM m),
    y AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY run) AS blk FROM x)
    SELECT doc_id, CAST(blk AS BIGINT) AS block_no, min(tag) AS tag, count(*) AS n_blocks, md5(string_agg(content, ' ' ORDER BY run)) AS content_md5 FROM y GROUP BY doc_id, blk""",
)
def q07(spark, sf_dir):
    """Tagged blocks (tables and code in one piece), then stretches of body blocks merged."""
    rows = enriched(spark, sf_dir).withColumn("line", F.expr("CASE WHEN line_no % 29 IN (14, 18) THEN '```' ELSE line END")).select("doc_id", "line_no", "line")
    blocks = sequence.tag_blocks(rows, ["doc_id"]).select("doc_id", F.col("run").alias("seq"), "tag", "content")
    merged = sequence.merge_runs(blocks, ["doc_id"], "seq", "tag", "content", ["body"])
    return merged.select("doc_id", F.col("run").cast("bigint").alias("block_no"), "tag", F.col("n").alias("n_blocks"), F.md5("content").alias("content_md5"))


SQL_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(
    "q08_exact_paragraph_dedupe",
    f"""WITH {LINES_SQL}, k AS (SELECT *, {SQL_KEY.format("line")} AS key FROM lines),
    n AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY doc_id, line_no) AS rn FROM k)
    SELECT doc_id, line_no, md5(line) AS line_md5 FROM n WHERE rn = 1 OR length(key) < 8""",
)
def q08(spark, sf_dir):
    """Lines that stay when repeated ones go, by language over all documents; short ones stay."""
    rows = lines(spark, sf_dir).select("lang", "doc_id", "line_no", "line")
    return dedup.exact_paragraphs(rows, ["lang"], ["doc_id", "line_no"]).select("doc_id", "line_no", F.md5("line").alias("line_md5"))


@query(
    "q09_repeated_heading_drop",
    f"""WITH {ENRICHED_SQL}, k AS (SELECT *, CASE WHEN regexp_matches(trim(line), {q(rules.H1)}) THEN lower(regexp_extract(trim(line), '^(\\w+\\s+\\d+)', 1)) END AS key FROM enriched),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no) AS rn FROM k)
    SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (key IS NULL OR rn = 1) AS BIGINT) AS kept, CAST(sum(CASE WHEN key IS NULL OR rn = 1 THEN length(line) ELSE 0 END) AS BIGINT) AS kept_chars FROM n GROUP BY doc_id""",
)
def q09(spark, sf_dir):
    """Chapter headings that come again in a document go."""
    s = F.trim("line")
    rows = enriched(spark, sf_dir).withColumn("key", F.when(s.rlike(rules.H1), F.lower(F.regexp_extract(s, r"^(\w+\s+\d+)", 1))))
    total = rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    kept = dedup.keep_first(rows, ["doc_id", "key"], ["doc_id", "line_no"], F.col("key").isNull()).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line")).cast("bigint").alias("kept_chars"))
    return total.join(kept, "doc_id")


@query(
    "q10_near_dup_pairs",
    f"""WITH p AS (SELECT item_id * 1000 + CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS id, unnest(string_split(text, chr(10))) AS line FROM benchmark),
    e AS (SELECT id, line FROM p UNION ALL SELECT id + 500000000, replace(line, ' the ', ' a ') || ' etc' FROM p),
    k AS (SELECT min(id) AS id, {SQL_KEY.format("line")} AS k FROM e WHERE length({SQL_KEY.format("line")}) >= 8 GROUP BY 2),
    g AS (SELECT id, list_distinct(list_transform(range(1, length(k) - 2), lambda i: substr(k, CAST(i AS BIGINT), 4))) AS g FROM k),
    s AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS n_both, len(a.g) AS na, len(b.g) AS nb FROM g a JOIN g b ON a.id < b.id AND least(len(a.g), len(b.g)) >= 0.6 * greatest(len(a.g), len(b.g)))
    SELECT a, b, round(CAST(n_both AS DOUBLE) / (na + nb - n_both), 9) AS similarity FROM s WHERE CAST(n_both AS DOUBLE) / (na + nb - n_both) >= 0.6""",
)
def q10(spark, sf_dir):
    """Pairs of like lines of the benchmark and of altered copies of them, by the exact join."""
    rows = sequence.lines_of(table(spark, sf_dir, "benchmark").select("item_id", "text")).select((F.col("item_id") * 1000 + F.col("line_no") + 1).alias("id"), "line")
    both = rows.unionByName(rows.select((F.col("id") + 500000000).alias("id"), F.concat(F.replace("line", F.lit(" the "), F.lit(" a ")), F.lit(" etc")).alias("line")))
    return dedup.exact_pairs(both, "id", "line").select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("q11_near_dup_greedy")
def q11(spark, sf_dir):
    """Paragraphs of each document that stay in the order-bound mode (tested against a plain Python fold)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    flags = docs.select("doc_id", dedup.greedy_paragraphs(F.split("text", "\n")).alias("kept"))
    return flags.select("doc_id", F.size("kept").cast("bigint").alias("paragraphs"), F.size(F.filter("kept", lambda k: k)).cast("bigint").alias("kept"))


ACCENTED = "àâäçéèêëîïñóôöùûüßáíúÀÂÄÇÉÈÊËÎÏÑÓÔÖÙÛÜÁÍÚ"


@query(
    "q12_script_ratio_filter",
    rf"""WITH {LINES_SQL}, r AS (SELECT doc_id, line_no, line, length(regexp_replace(line, '[^{ACCENTED}]', '', 'g')) AS own, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters FROM lines),
    k AS (SELECT *, letters > 0 AND CAST(own AS DOUBLE) / greatest(letters, 1) > 0.1 AS mostly FROM r)
    SELECT doc_id, CAST(count(*) FILTER (mostly) AS BIGINT) AS dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT mostly), '')) AS text_md5 FROM k GROUP BY doc_id""",
)
def q12(spark, sf_dir):
    """Lines of over a tenth of accented letters go."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    flagged = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), T.is_mostly(x, ACCENTED, 0.1).alias("mostly"))).alias("xs"))
    kept = flagged.select("doc_id", F.size("xs").alias("n"), F.transform(F.filter("xs", lambda x: ~x["mostly"]), lambda x: x["line"]).alias("left"))
    return kept.select("doc_id", (F.col("n") - F.size("left")).cast("bigint").alias("dropped"), F.md5(F.array_join("left", "\n")).alias("text_md5"))


@query(
    "q13_min_word_block_filter",
    rf"""WITH {ENRICHED_SQL} SELECT doc_id, count(*) AS blocks, CAST(count(*) FILTER (len(regexp_split_to_array(trim(line), '\s+')) >= 4 OR {rules.sql_is_heading("line")}) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN regexp_replace(line, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+')) END) AS BIGINT) AS words FROM enriched GROUP BY doc_id""",
)
def q13(spark, sf_dir):
    """Blocks of four words or more, and headings."""
    rows = enriched(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(rules.keeps_block(F.col("line"))).alias("kept"), F.sum(T.words(F.col("line"))).cast("bigint").alias("words"))


@query(
    "q31_token_batches",
    r"""WITH RECURSIVE l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS k, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, k, CASE WHEN regexp_replace(line, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+')) END AS words FROM l),
    s AS (SELECT *, CAST(floor(words * 1.33) AS INT) + 1 AS tokens FROM w),
    b(doc_id, k, bin, t, w) AS (SELECT doc_id, k, 0, tokens, words FROM s WHERE k = 1
      UNION ALL SELECT s.doc_id, s.k, CASE WHEN b.t + s.tokens > 600 OR b.w + s.words > 300 THEN b.bin + 1 ELSE b.bin END,
                       CASE WHEN b.t + s.tokens > 600 OR b.w + s.words > 300 THEN s.tokens ELSE b.t + s.tokens END, CASE WHEN b.t + s.tokens > 600 OR b.w + s.words > 300 THEN s.words ELSE b.w + s.words END
                FROM b JOIN s ON s.doc_id = b.doc_id AND s.k = b.k + 1)
    SELECT b.doc_id, CAST(b.bin AS BIGINT) AS bin, count(*) AS lines, CAST(sum(s.tokens) AS BIGINT) AS tokens, CAST(sum(s.words) AS BIGINT) AS words FROM b JOIN s ON s.doc_id = b.doc_id AND s.k = b.k GROUP BY 1, 2""",
)
def q31(spark, sf_dir):
    """Lines of each document in batches of at most 600 tokens and 300 words."""
    rows = lines(spark, sf_dir).select("doc_id", "line_no", T.words(F.col("line")).alias("words"))
    rows = rows.withColumn("tokens", T.tokens_estimate(F.col("words")))
    packed = sequence.pack(rows, ["doc_id"], "line_no", "tokens", 600, ("words", 300))
    return rows.join(packed, ["doc_id", "line_no"]).groupBy("doc_id", F.col("bin").cast("bigint").alias("bin")).agg(F.count("*").alias("lines"), F.sum("tokens").cast("bigint").alias("tokens"), F.sum("words").cast("bigint").alias("words"))


@query(
    "q33_appendix_latch",
    f"""WITH {LINES_SQL}, e AS (SELECT doc_id, line_no, CASE WHEN line_no = 5 + doc_id % 7 THEN 'Glossary ' || line ELSE line END AS line FROM lines),
    h AS (SELECT *, max(CAST(regexp_matches(line, '(?i)^\\s*(?:{"|".join(rules.APPENDIX_HEADS)})') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) = 1 AS app FROM e)
    SELECT doc_id, count(*) FILTER (NOT app) AS body_lines, count(*) FILTER (app) AS appendix_lines FROM h GROUP BY doc_id""",
)
def q33(spark, sf_dir):
    """Lines before and from the first appendix heading on."""
    rows = lines(spark, sf_dir).withColumn("line", F.expr("CASE WHEN line_no = 5 + doc_id % 7 THEN 'Glossary ' || line ELSE line END"))
    split = assembly.split_at_appendix(rows.select("doc_id", "line_no", "line"), ["doc_id"], ["line_no"])
    return split.groupBy("doc_id").agg(F.count_if(~F.col("in_appendix")).alias("body_lines"), F.count_if("in_appendix").alias("appendix_lines"))


@query(
    "q42_table_parse_pad",
    "SELECT p_partkey, CAST(2 AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS width, p_name || ';' || p_brand || ';/' || p_type || ';' || CAST(p_size AS VARCHAR) || ';extra' AS cells FROM part",
)
def q42(spark, sf_dir):
    """A two-row table of each part, separator dropped, the shorter row padded."""
    parts = table(spark, sf_dir, "part")
    text = F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |\n|---|---|\n|"), "p_type", F.lit("|"), F.col("p_size").cast("string"), F.lit("| extra |"))
    rows = render.parse_table(text)
    return parts.select("p_partkey", F.size(rows).cast("bigint").alias("n_rows"), F.size(rows[0]).cast("bigint").alias("width"), F.array_join(F.transform(rows, lambda r: F.array_join(r, ";")), "/").alias("cells"))


@query("q43_column_gap_table")
def q43(spark, sf_dir):
    """Column tables out of padded lines of each part (tested against plain Python); JVM and Arrow forms side by side."""
    parts = table(spark, sf_dir, "part")
    line = lambda a, b: F.concat(F.rpad(a, 40, " "), F.lit("    "), b)
    block = F.concat_ws("\n", line(F.lit("Name"), F.lit("Value")), line(F.col("p_brand"), F.col("p_type")), line(F.lit("size"), F.col("p_size").cast("string")))
    return parts.select("p_partkey", L.column_table_sql(block).alias("table_text"), L.column_tables(block).alias("arrow_text"))


@query("q44_line_join_fold")
def q44(spark, sf_dir):
    """Paragraphs after continuation lines are joined (tested against a plain Python fold)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    cut_up = F.split(F.regexp_replace("text", r", ", "\n"), "\n")
    joined = docs.select("doc_id", sequence.join_continuations(cut_up).alias("xs"))
    return joined.select("doc_id", F.size("xs").cast("bigint").alias("paragraphs"), F.md5(F.array_join("xs", "\n")).alias("text_md5"))


@query(
    "q46_structured_assembly",
    f"""WITH c AS (SELECT source AS doc_id, doc_id AS chunk_index, CASE WHEN doc_id % 11 = 3 THEN 'Appendix ' || text WHEN doc_id % 5 = 0 THEN 'Chapter ' || CAST(doc_id % 9 + 1 AS VARCHAR) || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id % 4 <> 1),
    s AS (SELECT *, regexp_matches(text, {q(rules.APPENDIX)}) AS app FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, app ORDER BY chunk_index) AS n FROM s),
    o AS (SELECT doc_id, CASE WHEN app THEN 'appendix' ELSE 'chapter' END AS section_type, n, 1 + row_number() OVER (PARTITION BY doc_id ORDER BY app, n) AS section_order FROM n)
    SELECT doc_id, section_type, CAST(n AS BIGINT) AS n, CAST(section_order AS BIGINT) AS section_order FROM o
    UNION ALL SELECT DISTINCT doc_id, 'front_matter', 1, 1 FROM c
    UNION ALL SELECT doc_id, 'back_matter', 1, count(*) + 2 FROM c GROUP BY doc_id""",
)
def q46(spark, sf_dir):
    """Sections of a book for each source, with documents as chunks."""
    text = F.expr("CASE WHEN doc_id % 11 = 3 THEN 'Appendix ' || text WHEN doc_id % 5 = 0 THEN 'Chapter ' || CAST(doc_id % 9 + 1 AS STRING) || '\n' || text ELSE text END")
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), text.alias("text"), F.when(F.col("doc_id") % 4 != 1, "COMPLETED").otherwise("PENDING").alias("status"))
    return assembly.numbered_sections(chunks).select("doc_id", "section_type", F.col("n").cast("bigint").alias("n"), F.col("section_order").cast("bigint").alias("section_order"))


@query(
    "q47_export_numbering",
    f"""WITH {ENRICHED_SQL}, s AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(trim(line), {q(rules.H1)}) THEN 'chapter' WHEN line_no % 5 = 1 THEN 'front_matter' ELSE 'body' END AS section_type, line FROM enriched),
    e AS (SELECT * FROM s WHERE section_type <> 'front_matter' AND trim(line) <> ''),
    n AS (SELECT *, CASE WHEN section_type = 'chapter' THEN sum(CAST(section_type = 'chapter' AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) END AS c FROM e)
    SELECT doc_id, line_no, section_type, CAST(coalesce(c, 0) AS BIGINT) AS chapter_no, coalesce(c > 1, TRUE) AS page_break FROM n""",
)
def q47(spark, sf_dir):
    """Chapter numbers and page breaks of lines taken as sections."""
    s = F.trim("line")
    rows = enriched(spark, sf_dir).select("doc_id", F.col("line_no").alias("section_order"), F.when(s.rlike(rules.H1), "chapter").when(F.col("line_no") % 5 == 1, "front_matter").otherwise("body").alias("section_type"), F.col("line").alias("text"))
    return assembly.export_plan(rows).select("doc_id", F.col("section_order").alias("line_no"), "section_type", F.coalesce("chapter_no", F.lit(0)).cast("bigint").alias("chapter_no"), "page_break")


@query("q48_json_salvage", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def q48(spark, sf_dir):
    """A number out of JSON that has chat around it."""
    noisy = F.concat(F.lit("Here you are: ["), "props", F.lit("] ok?"))
    return table(spark, sf_dir, "events").select("event_id", models.salvage_json(noisy, "array<struct<k:bigint>>")[0]["k"].alias("k"))


@query(
    "q41_integrity_check",
    rf"""WITH r AS (SELECT item_id, text || ' gives 25 mg' AS old, replace(text, 'The ', 'the ') || CASE WHEN item_id % 3 = 0 THEN ' gives 5 mg' ELSE ' gives 125 mg' END AS new FROM benchmark)
    SELECT item_id, len(list_filter(regexp_extract_all(old, '{render.NUMBER}'), lambda x: NOT contains(new, x))) = 0
       AND len(list_filter(regexp_extract_all(old, '{render.UNIT}'), lambda x: NOT contains(lower(new), lower(x)))) = 0
       AND len(list_filter(regexp_extract_all(old, '{render.TERM}'), lambda x: x NOT IN ({", ".join(map(q, render.COMMON_CAPITALS))}) AND NOT contains(new, x))) = 0 AS kept FROM r""",
)
def q41(spark, sf_dir):
    """Whether numbers, units and names of benchmark texts survive a rewriting (substrings count: 25 is in 125)."""
    rows = table(spark, sf_dir, "benchmark")
    old = F.concat("text", F.lit(" gives 25 mg"))
    new = F.concat(F.replace("text", F.lit("The "), F.lit("the ")), F.when(F.col("item_id") % 3 == 0, " gives 5 mg").otherwise(" gives 125 mg"))
    return rows.select("item_id", render.keeps_facts(old, new).alias("kept"))
