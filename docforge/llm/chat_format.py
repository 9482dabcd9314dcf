"""Chat formatting with typed content parts, in DataFrame functions only.

Each turn becomes ``<turn>role<text>body</turn>\\n``. A visitor walks the parts of a turn in order: image, audio and
document parts become the placeholders <image>, <audio> and <document>; their references and expanded token counts go
to ``attachments`` in the same order. Text parts with no placeholder between are one text, and escaped as one, so that
parts can't form what neither holds. Inside roles and texts a backslash is doubled and every string that the template
gives a meaning gets a backslash behind its "<", so that none of them can occur in a body and ``unescape`` restores the
text exactly.

Result per conversation: conv_id, formatted, turn_loss (one flag a turn: is it trained on), loss_spans (start, end in
code points of ``formatted``, end exclusive; the same place told by its turn, from 0, and the code points of that turn
before it), attachments, attachment_tokens. ``loss_texts`` reads the spans.

Defined results: turns go by turn (null first), then role, then text; a null text or role is empty; null parts mean the
one text part of the text column; a part of an unknown type counts as text; null tokens count 0. Repeated rows are
repeated turns. A null conv_id is a conversation of its own. An empty table gives no rows. Columns besides those named
are not read. One shuffle by conversation serves the window and the aggregate; rows are formatted before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"
MEDIA = ["image", "audio", "document"]
CONTROL = r"(?:/?turn|text|image|audio|document)>"
TRAINED_ROLES = ["assistant"]
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    """A backslash before each backslash, and before what follows the < of a control string."""
    return F.regexp_replace(text, rf"\\|(?<=<)(?={CONTROL})", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, trained: list[str] = TRAINED_ROLES) -> DataFrame:
    """parts: a column of array<struct<type, text, ref, tokens>>."""
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))
    visited = F.coalesce(F.col(parts).cast(f"array<{PART}>"), plain) if parts else plain
    is_media = lambda p: F.coalesce(p["type"].isin(MEDIA), F.lit(False))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visited.alias("parts"))
    if parts:
        # done: escaped so far; held: text since the last placeholder, not yet escaped
        visit = lambda v, p: F.when(is_media(p), F.struct(F.concat(v["done"], escape(v["held"]), F.lit("<"), p["type"], F.lit(">")).alias("done"), F.lit("").alias("held"))).otherwise(F.struct(v["done"].alias("done"), F.concat(v["held"], F.coalesce(p["text"], F.lit(""))).alias("held")))
        body = F.aggregate("parts", F.struct(F.lit("").alias("done"), F.lit("").alias("held")), visit, lambda v: F.concat(v["done"], escape(v["held"])))
        files = F.transform(F.filter("parts", is_media), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens")))
    else:
        body = F.coalesce(escape(F.col("parts")[0]["text"]), F.lit(""))
        files = F.array().cast("array<struct<turn:bigint,type:string,ref:string,tokens:bigint>>")
    rows = rows.select("conv_id", "turn", "role", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY)).alias("head"), body.alias("body"), files.alias("files"))
    rows = rows.select("conv_id", "turn", "role", F.length("head").alias("n_head"), F.length("body").alias("n_body"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "files")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    upto = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = upto - F.length("piece") + F.col("n_head")
    ordered = rows.select("conv_id", F.struct(F.row_number().over(order).alias("n"), "piece", F.col("n_head").cast("long").alias("skip"), F.col("role").isin(trained).alias("loss"), start.cast("long").alias("start"), (start + F.col("n_body")).cast("long").alias("end"), "files").alias("t"))
    joined = ordered.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return joined.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("ts", lambda t: t["loss"]).alias("turn_loss"),
        F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), (t["n"] - 1).alias("turn"), t["skip"].alias("skip"))).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: t["files"])).alias("attachments"),
    ).select("*", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"))


def pieces_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, without their ends."""
    pieces = F.split(formatted, CLOSE, -1)
    return F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>> out of a formatted conversation: what was put in, unescaped."""
    heads = lambda p: F.substring_index(p, BODY, 1)
    return F.transform(pieces_of(formatted), lambda p: F.struct(unescape(F.substring(heads(p), F.lit(len(OPEN) + 1), F.length(p))).alias("role"), unescape(F.substring(p, F.length(heads(p)) + F.lit(len(BODY) + 1), F.length(p))).alias("text")))


def loss_texts(pieces: Column, spans: Column) -> Column:
    """The text of each loss span, unescaped, read out of its own turn: linear, however many turns stand before it."""
    return F.transform(spans, lambda s: unescape(F.substring(F.get(pieces, s["turn"]), (s["skip"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every conversation and conversation -7; all digests are read back from the formatted output."""
    from docforge.llm.common import table

    probe = spark.sql(r"""SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)""")
    chats = format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    read = chats.select("conv_id", "formatted", "loss_spans", parse_chat(F.col("formatted")).alias("turns"), pieces_of(F.col("formatted")).alias("pieces"))
    read = read.select("conv_id", "formatted", "turns", F.array_join(loss_texts(F.col("pieces"), F.col("loss_spans")), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, 20 + length(regexp_replace(role, '(\\|<(/?turn|text|image|audio|document)>)', '\1+', 'g'))
                  + length(regexp_replace(text, '(\\|<(/?turn|text|image|audio|document)>)', '\1+', 'g')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""
