"""Token counts of whole documents, with overlap resynchronisation for huge ones.

A document over CHUNK characters is encoded in chunks that overlap. Between neighbours a splice point is looked for in
the overlap: a place where both encodings begin a token, and that is proven stable (where kinds of characters meet, or
two bytes that no token holds; see vocab.py). The left chunk counts up to it and the right one from it on. If there is
none, the left chunk is encoded anew from the last splice over twice the length, and overlaps twice as wide, so that
time stays in proportion to the text, spaces or not. Tokenizers without that proof, sentencepiece models among them, are
given whole texts.

Result per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Defined results: a null or empty text has 0
bytes and tokens; repeated rows are counted one by one; null ids stay; an empty table gives no rows; other columns are
not read. Rows never meet: no shuffle, and memory holds one Arrow batch and the chunks of one document.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.vocab import BYTE_BPE, cached_library, forced_of, library, proven_places, splits_at_spaces

LIMIT = 512
CHUNK, OVERLAP = 1 << 15, 1 << 9


def _starts(encoder, text: str, start: int, end: int) -> list[int]:
    return [start + a for a, _ in encoder.encode(text[start:end], add_special_tokens=False).offsets]


def splice_point(text: str, left: list[int], right: list[int], start: int, end: int, forced: bytes, special: list[str]) -> int | None:
    """The first proven place in text[start:end] where both lists of token starts have an entry."""
    for p in proven_places(text, start, end, forced, special):
        i, j = bisect.bisect_left(left, p), bisect.bisect_left(right, p)
        if i < len(left) and left[i] == p and j < len(right) and right[j] == p:
            return p
    return None


def count_huge(text: str, encoder, chunk: int = CHUNK, overlap: int = OVERLAP, forced: bytes | None = None) -> int:
    """Tokens of a text, by chunks spliced in their overlaps. A chunk that can't be spliced goes on over as much again, from
    the last splice on, with twice the overlap: nothing is encoded more often than a few times, whatever the text."""
    special = [t.content for t in encoder.get_added_tokens_decoder().values()]
    forced = forced_of(BYTE_BPE) if forced is None else forced
    total, done, end, wide = 0, 0, min(len(text), chunk + overlap), overlap
    left = _starts(encoder, text, done, end)
    while end < len(text):
        start = max(done, end - wide)
        right_end = min(len(text), start + wide + chunk)
        right = _starts(encoder, text, start, right_end)
        p = splice_point(text, left, right, start, end, forced, special)
        if p is None:
            end, wide = min(len(text), 2 * end - done), 2 * wide
            left = _starts(encoder, text, done, end)
            continue
        total += bisect.bisect_left(left, p) - bisect.bisect_left(left, done)
        done, left, end, wide = p, right, right_end, overlap
    return total + len(left) - bisect.bisect_left(left, done)


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docforge.llm.common import slices, texts_of

        words, whole, stable = cached_library(tokenizer), library(tokenizer), splits_at_spaces(tokenizer)
        forced = forced_of(tokenizer) if stable else b""
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            huge = [stable and len(t) > chunk for t in texts]
            short = iter(words.ids([t for t, h in zip(texts, huge) if not h]))
            n = [count_huge(t, whole, chunk, overlap, forced) if h else len(next(short)) // 4 for t, h in zip(texts, huge)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document."""
    from docforge.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents"))
