"""Exam papers: blocks to questions, options and answers, and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import answers as A
from docforge.functions import rules
from docforge.functions.text import normalize_text, strip, strip_script
from docforge.operators import lineage
from docforge.operators.columns import fresh
from docforge.operators.dedup import keep_first
from docforge.operators.lines import settled
from docforge.operators.scan import Running, large_groups, same, scan
from docforge.operators.sequence import sessionise
from docforge.sources.tables import spread

# How question and option tags are printed.
QUESTION_HEADER = r"(?i)Question\s+Number\s*:\s*(\d+)"
QUESTION_ID = r"(?i)Question\s+Id\s*:\s*(\d+)"
OBJECTIVE = r"(?i)Objective\s+Question\b"
QUESTION_TAG = r"(?i)\[Question\s*ID\s*=\s*(\d+)\]"
DESCRIPTION_TAG = r"(?i)\[Question\s*Description\s*=\s*[^\]]+\]"
OPTION_TAG = r"(?i)\[Option\s*ID\s*=\s*(\d+)\]"
SERIAL_AND_ID, ID_AND_MARKS, ID_ONLY, SERIAL_ONLY = r"^(\d{1,4})\s+(\d{5,7})(?:\s|$)", r"^(\d{5,7})\s+\d+(?:\.\d+)?\s*$", r"^(\d{5,7})$", r"^(\d{1,4})$"


def group_questions(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, group_no, q_num, q_id, images): a header opens a group, images attach to the open one; those before the first go."""
    text = F.col("kind") == "text"
    marked = sessionise(blocks, [doc], ["seq"], text & F.col("text").rlike(QUESTION_HEADER))
    first = lambda p: F.min_by(F.nullif(F.regexp_extract("text", p, 1), F.lit("")), F.when(text & F.col("text").rlike(p), F.col("seq")))
    images = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "image", F.struct("seq", "xref")))), lambda x: x["xref"])
    return marked.where("group_no > 0").groupBy(doc, "group_no").agg(first(QUESTION_HEADER).cast("int").alias("q_num"), first(QUESTION_ID).alias("q_id"), images.alias("images"))


def section_headers(blocks: DataFrame, doc: str = "doc_id", most: int = 20) -> DataFrame:
    """The first section headers that stand before the first question (a cover shows so many)."""
    marked = sessionise(blocks, [doc], ["seq"], F.col("text").rlike(QUESTION_HEADER))
    found = marked.where((F.col("group_no") == 0) & rules.is_section_header(F.col("text")))
    return found.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("seq"))).where(F.col("n") <= most)


def group_objective_questions(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The other format: "Objective Question" opens, and the texts behind it say number and id until one that is neither.

    Page chrome between is skipped. Only the texts before the first that is something else are looked at.
    """
    # texts are judged before rows are shuffled and sorted, which then hold no text
    text = F.col("kind") == "text"
    head = text & F.col("text").rlike(OBJECTIVE)
    form = F.when(head, "head").when(text & rules.is_page_chrome(F.col("text")), "skip").when(~text, "image").when(F.col("text").rlike(SERIAL_AND_ID), "both").when(F.col("text").rlike(ID_AND_MARKS) | F.col("text").rlike(ID_ONLY), "id").when(F.col("text").rlike(SERIAL_ONLY), "serial").otherwise("other")
    ident = F.when(F.col("form") == "both", F.regexp_extract("text", SERIAL_AND_ID, 2)).when(F.col("form") == "id", F.regexp_extract("text", r"^(\d{5,7})", 1))
    ends = F.col("form").isin("other", "id", "both")
    judged = blocks.withColumn("form", form).select(doc, "seq", (F.col("form") == "head").alias("head"), F.when(ends, F.struct(ident.alias("id"))).alias("ends"), (F.col("kind") == "image").alias("image"), "xref")
    rows = sessionise(judged, [doc], ["seq"], F.col("head")).where("group_no > 0")
    # the first text that is more than chrome or a serial number says the id, or that there is none
    number = F.min_by(F.col("ends.id"), F.when(F.col("ends").isNotNull(), F.col("seq")))
    images = F.transform(F.array_sort(F.collect_list(F.when(F.col("image"), F.struct("seq", "xref")))), lambda x: x["xref"])
    groups = rows.groupBy(doc, "group_no").agg(F.coalesce(number, F.lit("")).alias("q_id"), images.alias("images")).where(F.size("images") > 0)
    return groups.withColumn("q_num", F.row_number().over(Window.partitionBy(doc).orderBy("group_no")))


def split_questions(spans: DataFrame, doc: str = "doc_id", text: str = "text", seq: str = "seq", kind: str = "kind", xref: str = "xref") -> DataFrame:
    """(doc, q_num, q_id, stem, option_text, images): the questions of papers printed as text.

    spans: text and image blocks in order (kind and xref of a column-less table: all text; without ``seq`` each row is a
    document). A stem begins behind the last option tag before it, or behind the last question tag where no option was
    seen yet, and ends at its own tag; options run to the last option tag before the next question tag, or to that tag
    where a question has none. Images belong to the question in whose stem or options they stand. Page furniture,
    descriptions and lines of another script go; brackets that are no tag are text. Questions with nothing left go, and the
    rest are numbered anew. A tag stands within one block.

    A document's blocks are never joined to one text: tags cut each block, what is behind a tag is a piece, and how many
    question and option tags came before (scans over parts of a document) say to which stem and options a piece belongs.
    Blocks are dealt over all cores before they are read, once; pieces are asked for large documents once, for all scans.
    """
    spans = spread(spans)
    rows = spans.select(
        F.col(doc).alias("d"), (F.col(seq) if seq in spans.columns else F.lit(0)).cast("bigint").alias("seq"),
        (F.col(kind) == "image" if kind in spans.columns else F.lit(False)).alias("image"), F.col(text).alias("text"), (F.col(xref) if xref in spans.columns else F.lit(None)).cast("bigint").alias("xref"),
    )
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: ~rules.is_page_chrome(strip(x), printed=True))
    texts = rows.where("NOT image AND text IS NOT NULL").withColumn("text", F.array_join(lines, "\n"))
    texts = settled(texts, ["text"]).where(strip(F.col("text")) != "")
    any_tag = r"(?i)\[(?:Question|Option)\s*ID\s*=\s*\d+\]"
    parted = texts.select("d", "seq", F.posexplode(F.split("text", f"(?={any_tag})")).alias("k", "piece")).where("k = 0 OR piece <> ''").withColumn("tag", F.regexp_extract("piece", f"^({any_tag})", 1))
    bare, lead = F.col("tag") == "", F.when(F.col("k") == 0, "\n").otherwise("")
    behind = F.concat(F.when(bare, lead).otherwise(""), F.expr("substring(piece, length(tag) + 1)"))
    form = F.when(bare, "text").when(F.col("tag").rlike(QUESTION_TAG), "question").otherwise("option")
    pieces = parted.select("d", "seq", "k", form.alias("form"), F.concat(F.when(bare, "").otherwise(lead), "tag").alias("tag"), behind.alias("body"), F.lit(None).cast("bigint").alias("xref"))
    images = rows.where("image").select("d", "seq", F.lit(0).alias("k"), F.lit("image").alias("form"), F.lit("").alias("tag"), F.lit("").alias("body"), "xref")
    is_q, is_o = F.col("form") == "question", F.col("form") == "option"
    pieces = lineage.cut(pieces.unionByName(images))
    large = large_groups(pieces, ["d"])
    counted = scan(pieces, ["d"], ["seq", "k"], {"q": Running(is_q.cast("bigint")), "o": Running(is_o.cast("bigint"))}, large=large)
    # read twice below: cut once
    events = lineage.cut(scan(counted, ["d"], ["seq", "k"], {"first": Running(F.when(is_q, F.col("o")), "last")}, large=large))

    # options: a question's pieces up to its last option tag
    own_q = Window.partitionBy("d", "q")
    mine = events.where("q > 0").withColumns({"m": F.max("o").over(own_q), "f": F.min("first").over(own_q), "end": F.max(F.when(F.col("form") != "image", F.struct("seq", "k"))).over(own_q)})
    mine = mine.withColumn("none", F.col("m") == F.col("f"))
    # of a question without options, images behind all its text are none of its
    inside = F.when(F.col("none"), (F.col("form") != "image") | (F.struct("seq", "k") < F.col("end"))).otherwise((F.col("o") < F.col("m")) | is_o)
    own = F.when(is_q, F.col("body")).when(is_o & (F.col("o") == F.col("m")), F.col("tag")).otherwise(F.concat("tag", "body"))
    ordered = lambda *cs: F.array_sort(F.collect_list(F.struct("seq", "k", *cs)))
    options = mine.where(inside).groupBy("d", "q").agg(ordered(own.alias("t"), "xref").alias("xs"))
    options = options.select("d", "q", F.array_join(F.transform("xs", lambda x: x["t"]), "").alias("after"), F.filter(F.transform("xs", lambda x: x["xref"]), lambda x: x.isNotNull()).alias("below"))

    # stems: all before the first question tag; else the pieces behind the last option tag, for each question tag before the
    # next one; else, before all options, those behind a question tag
    told = lambda shown, o, part, form=F.col("form"), tag=F.col("tag"), body=F.col("body"): F.when(shown, F.struct(o.cast("bigint").alias("o"), part.cast("bigint").alias("part"), form.alias("form"), tag.alias("tag"), body.alias("body")))
    none, first, blank = F.col("o") == 0, F.col("q") == 1, F.lit("")
    copies = F.array(
        told(F.col("q") == 0, F.lit(-1), F.lit(0)),
        told(is_q & first, F.lit(-1), F.lit(0), body=blank),
        told(none & ~is_q & (F.col("q") > 0), F.col("o"), F.col("q")),
        told(none & is_q, F.col("o"), F.col("q"), form=F.lit("text"), tag=blank),
        told(none & is_q & ~first, F.col("o"), F.col("q") - 1, body=blank),
        told(~none & ~(is_q & first), F.col("o"), F.lit(-1)),
        told(~none & is_q & first, F.col("o"), F.lit(-1), form=F.lit("text")),
    )
    heads = events.select("d", "seq", "k", "q", "xref", F.inline(F.filter(copies, lambda c: c.isNotNull())))
    asked = F.max(is_q).over(Window.partitionBy("d", "o", "part"))
    said = F.when(is_o & (F.col("o") >= 0), F.col("body")).otherwise(F.concat("tag", "body"))
    groups = heads.withColumn("asked", asked).where("asked").groupBy("d", "o", "part").agg(ordered(said.alias("t"), "xref", F.when(is_q, F.col("q")).alias("q"), "tag").alias("xs"))
    each = groups.select("d", "xs", F.posexplode("xs").alias("at", "x")).where("x.q IS NOT NULL")
    before = F.slice("xs", F.lit(1), F.col("at"))
    stems = each.select("d", F.col("x.q").alias("q"), F.regexp_extract("x.tag", QUESTION_TAG, 1).alias("q_id"), F.array_join(F.transform(before, lambda x: x["t"]), "").alias("stem"), F.filter(F.transform(before, lambda x: x["xref"]), lambda x: x.isNotNull()).alias("above"))

    clean = lambda c: F.regexp_replace(c, DESCRIPTION_TAG, "")
    stem = strip(normalize_text(strip(strip_script(strip(F.regexp_replace(clean(F.col("stem")), OPTION_TAG, ""))))))
    both = stems.alias("s").join(options.alias("p"), same("s", "p", ["d", "q"]), "left").select("s.d", "s.q", "q_id", stem.alias("stem"), clean(F.coalesce("after", F.lit(""))).alias("option_text"), F.concat("above", F.coalesce("below", F.array().cast("array<bigint>"))).alias("images"))
    both = settled(both, ["stem", "option_text", "images"])
    some = both.where((F.col("stem") != "") | (F.size(options_of(F.col("option_text"))) > 0) | (F.size("images") > 0))
    some = some if large is None else lineage.cut(some)
    return scan(some, ["d"], ["q"], {"q_num": Running(F.lit(1).cast("bigint"))}, large=large).select(F.col("d").alias(doc), "q_num", "q_id", "stem", "option_text", "images")


def options_of(text: Column) -> Column:
    """array<struct<number, text, option_id>>: cut before "n." at the beginning of a line."""
    parts = F.filter(F.split(text, r"(?m)(?=^\s*[1-9]\s*\.)"), lambda p: p.rlike(r"^\s*[1-9]\s*\."))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^\s*([1-9])", 1).cast("int").alias("number"),
            strip(normalize_text(F.regexp_replace(strip_script(strip(F.regexp_replace(F.regexp_replace(p, r"^\s*[1-9]\s*\.\s*", ""), OPTION_TAG, ""))), r"\n{2,}", "\n"))).alias("text"),
            F.nullif(F.regexp_extract(p, OPTION_TAG, 1), F.lit("")).alias("option_id"),
        ),
    )


def paper_format(blocks: DataFrame, doc: str = "doc_id", enough: int = 3) -> DataFrame:
    """(doc, format) by the block where one of the two kinds of header was seen often enough, or the last: objective if
    its marker leads there, else standard."""
    n = lambda p: Running(F.coalesce(F.col("text").rlike(p), F.lit(False)).cast("int"))
    counted = scan(blocks.where("kind = 'text'").select(doc, "seq", "text"), [doc], ["seq"], {"standard": n(QUESTION_HEADER), "objective": n(OBJECTIVE)})
    reached = (F.col("standard") >= enough) | (F.col("objective") >= enough)
    at = F.struct(F.when(reached, 0).otherwise(1), F.when(reached, F.col("seq")).otherwise(-F.col("seq")))
    return counted.groupBy(doc).agg(F.min_by(F.col("objective") > F.col("standard"), at).alias("o")).select(doc, F.when(F.col("o"), "objective").otherwise("standard").alias("format"))


def detect_format(pages: DataFrame) -> DataFrame:
    """(doc_id, format): objective if its marker is seen more often than question headers on the pages, else standard;
    text if the first five pages hold three question tags and six option tags; scan if the first eight have no text but images."""
    n = lambda p: F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0))
    early = lambda p, k: F.coalesce(F.sum(F.when(F.col("page_num") <= k, F.regexp_count("text", F.lit(p)))), F.lit(0))
    chars = F.coalesce(F.sum(F.when(F.col("page_num") <= 8, F.length(F.trim("text")))), F.lit(0))
    images = F.coalesce(F.sum(F.when(F.col("page_num") <= 8, F.col("n_images"))), F.lit(0))
    stats = pages.groupBy("doc_id").agg(n(OBJECTIVE).alias("objective"), n(QUESTION_HEADER).alias("standard"), early(QUESTION_TAG, 5).alias("q"), early(OPTION_TAG, 5).alias("o"), chars.alias("chars"), images.alias("images"))
    return stats.select("doc_id", F.when((F.col("chars") == 0) & (F.col("images") > 0), "scan").when((F.col("q") >= 3) & (F.col("o") >= 6), "text").when(F.col("objective") > F.col("standard"), "objective").otherwise("standard").alias("format"))


def with_answers(questions: DataFrame, answers: DataFrame, q_id: str = "q_id") -> DataFrame:
    """Questions, with their answers where there are any; an empty id matches none. Answers have one row an id
    (keys.entries_of makes them so), else questions would repeat; where they don't, any one of an id's is taken."""
    own = answers.groupBy(F.col("question_id").alias(q_id)).agg(F.any_value("answer").alias("answer"))
    usable = F.when(F.col(f"q.{q_id}") != "", F.col(f"q.{q_id}"))
    return questions.alias("q").join(own.alias("a"), usable == F.col(f"a.{q_id}"), "left").select("q.*", "a.answer", F.col("a.answer").isNotNull().alias("found"))


def matched_missing_extra(questions: DataFrame, answers: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return questions.join(answers, key, "left_semi"), questions.join(answers, key, "left_anti"), answers.join(questions, key, "left_anti")


def best_subject(questions: DataFrame, answers: DataFrame, key: str = "q_id", subject: str = "subject", order: str = "subject_order") -> DataFrame:
    """(subject, order, overlap, best): how many of the ids each subject answers; the first of the largest, if not 0, is best.

    The best one is an aggregate of a row, which is broadcast: no task sees all subjects. Subjects of one order go by name.
    """
    ids = questions.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(key).distinct()
    hits = answers.join(ids, key, "left_semi").groupBy(subject).agg(F.count_distinct(key).alias("overlap"))
    every = answers.groupBy(subject).agg(F.min(order).alias(order))
    counted = every.join(hits, subject, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    top = fresh(counted, "_top")
    first = counted.agg(F.min(F.struct(-F.col("overlap"), order, subject)).alias(top))
    return counted.crossJoin(F.broadcast(first)).withColumn("best", F.struct(-F.col("overlap"), order, subject).eqNullSafe(F.col(top)) & (F.col("overlap") > 0)).drop(top)


def resolve_answers(questions: DataFrame) -> DataFrame:
    """answer_text and found of questions with columns raw, kind and options."""
    done = A.resolve(F.col("raw"), F.col("kind"), F.col("options"))
    made = fresh(questions, "_made")
    return questions.withColumn(made, done).select(*questions.columns, F.col(f"{made}.text").alias("answer_text"), F.col(f"{made}.found").alias("found"))


def drop_twin_images(images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The uppermost image of each question."""
    y = fresh(images, "_y")
    return keep_first(images.withColumn(y, F.bround("y0", 1)), [doc, "q_num"], ["page_idx", y, "seq"]).drop(y)

