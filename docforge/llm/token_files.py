"""Token-id files with fixed-width bit packing.

Every id takes the fewest bits that the vocabulary needs. A file is a run of blocks, each ended by a newline:

    magic "TKB1" | width u8 | 3 zero bytes | shard u32 | n_docs u32 | first u64 | n_ids u64 | payload bytes u64 |
    doc ids i64[n_docs] | null flags u8[n_docs] | offsets u64[n_docs + 1] | payload

``first`` is the position of the block's first id in its shard, ``offsets`` are the documents' places in the block, and
id i of a block lies at bit i * width of the payload (bit 0 is a byte's lowest), so any run of ids is unpacked on its
own, by numpy; ``index_token_files`` lists blocks for that. A document is never divided between blocks. Shards are ranges of ascending doc_id; Spark's text writer
stores the blocks, so writes go to any file system that Spark knows and are committed once, whatever tasks are retried.

Defined results: a null text counts as empty (only the end id); null doc_ids come first; rows of equal doc_id stand
next to each other, ordered by the hash of their text, so that runs agree and a hot id is spread. An empty table has no
files and gives no rows. Other columns are not read. One shuffle, by range of (doc_id, hash); memory holds one block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.llm.common import cut, partitions, remove, scratch, slices, texts_of
from docforge.llm.vocab import BYTE_BPE, cached_library, vocabulary_size

MAGIC, HEAD = b"TKB1", struct.Struct("<4sB3xIIQQQ")
END_ID = 0
BLOCK_IDS = 1 << 20
BLOCKS_A_FILE = 16


def width_of(vocabulary: int) -> int:
    """Bits that an id needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids as consecutive fields of width bits."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of 8 ids: parts end on whole bytes
        some = ids[at : at + (1 << 16)].astype("<u4")
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """count ids from place start on, whatever lies around them."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, start * width // 8).astype("<u4")
    out = np.empty(count, "<u4")
    for at in range(0, count, 1 << 16):
        n = min(1 << 16, count - at)
        bit = (start + at) * width
        raw = np.frombuffer(payload, np.uint8, (bit + n * width + 7) // 8 - bit // 8, bit // 8)
        bits = np.unpackbits(raw, bitorder="little")[bit % 8 : bit % 8 + n * width].reshape(n, width)
        out[at : at + n] = bits @ (1 << np.arange(width, dtype=np.uint32))
    return out


def unpack_from_bit(part: bytes, width: int, bit: int, count: int) -> np.ndarray:
    """count ids that begin at that bit of a part of a payload."""
    bits = np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")[bit : bit + count * width].reshape(count, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64).astype("<u4")


def make_block(shard: int, first: int, docs: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    offsets = np.cumsum([0, *map(len, ids)], dtype="<u8")
    payload = pack(np.concatenate(ids), width)
    null = np.asarray([d is None for d in docs], np.uint8)
    return HEAD.pack(MAGIC, width, shard, len(docs), first, int(offsets[-1]), len(payload)) + np.asarray([d or 0 for d in docs], "<i8").tobytes() + null.tobytes() + offsets.tobytes() + payload


def head_size(n_docs: int) -> int:
    """Bytes of a block before its payload."""
    return HEAD.size + 17 * n_docs + 8


def blocks_of(content: bytes) -> Iterator[tuple[int, int, int, list[int | None], np.ndarray, memoryview]]:
    """(shard, first, width, doc ids, offsets, payload) of each block of a file."""
    at, view = 0, memoryview(content)
    while at < len(content):
        magic, width, shard, n, first, _, size = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block begins at byte {at}")
        at += HEAD.size
        docs = np.frombuffer(content, "<i8", n, at).tolist()
        null = np.frombuffer(content, np.uint8, n, at + 8 * n)
        offsets = np.frombuffer(content, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        yield shard, first, width, [None if z else d for d, z in zip(docs, null)], offsets, view[at : at + size]
        at += size + 1


def write_token_files(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE, end_id: int = END_ID, block_ids: int = BLOCK_IDS, blocks_a_file: int = BLOCKS_A_FILE) -> None:
    """Writes the files under path, in ascending doc_id order by shard and place."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first = TaskContext.get().partitionId(), 0
        words = cached_library(tokenizer)
        width = width_of(vocabulary_size(tokenizer))
        end = np.asarray([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in slices(batches):
            for doc, own in zip(batch.column(0).to_pylist(), words.ids(texts_of(batch.column(1)))):
                docs.append(doc)
                ids.append(np.frombuffer(own + end, "<u4"))
                held += len(ids[-1])
                if held >= block_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([make_block(shard, first, docs, ids, width)], pa.binary())], ["value"])
                    first, held, docs, ids = first + held, 0, [], []
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([make_block(shard, first, docs, ids, width)], pa.binary())], ["value"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(df.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(blocks, "value binary").select(F.col("value").cast("string")).write.option("compression", "none").option("maxRecordsPerFile", blocks_a_file).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """shard, place (in the shard), doc_id, n_tokens, ids_crc32 of every document, from the files alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for shard, first, width, docs, offsets, payload in blocks_of(batch.column(0)[0].as_py()):
                ids = unpack(payload, width, 0, int(offsets[-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array(first + offsets[:-1], pa.int64()), pa.array(docs, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["shard", "place", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(digest, "shard int, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")


def index_path(path: str) -> str:
    return path.rstrip("/") + ".blocks"


def index_token_files(spark: SparkSession, path: str) -> None:
    """Writes the index of the files beside them: a row a block with its file, place and bytes, and the ids it holds."""

    def list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            file, content, at = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), 0
            for shard, first, _, docs, _, payload in blocks_of(content):
                size = head_size(len(docs)) + len(payload)
                named = [d for d in docs if d is not None]
                row = [file, at, size, shard, first, len(docs), min(named, default=None), max(named, default=None), len(named) < len(docs)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()])], names)
                at += size + 1

    names = ["file", "at", "size", "shard", "first", "n_docs", "least", "most", "has_null"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.select("path", "content").mapInArrow(list_blocks, "file string, at bigint, size bigint, shard int, first bigint, n_docs bigint, least bigint, most bigint, has_null boolean")
    rows.write.mode("overwrite").parquet(index_path(path))


def read_bytes(spark: SparkSession, file: str, at: int, count: int) -> bytes:
    """That part of a file, by the file system that its scheme names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(at)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, count))
    finally:
        stream.close()


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the rows of one document, by the index (index_token_files): of each block that may hold it the head is read,
    and of the payload only the document's own bytes."""
    found = []
    for block in spark.read.parquet(index_path(path)).where((F.col("least") <= doc_id) & (F.col("most") >= doc_id)).orderBy("shard", "first").toLocalIterator():
        head = read_bytes(spark, block.file, block.at, head_size(block.n_docs))
        _, width, _, n, _, _, size = HEAD.unpack_from(head)
        docs = np.frombuffer(head, "<i8", n, HEAD.size)
        null = np.frombuffer(head, np.uint8, n, HEAD.size + 8 * n)
        offsets = np.frombuffer(head, "<u8", n + 1, HEAD.size + 9 * n).astype(np.int64)
        for k in np.flatnonzero((docs == doc_id) & (null == 0)).tolist():
            a, b = int(offsets[k]), int(offsets[k + 1])
            low, high = a * width // 8, min(size, (b * width + 7) // 8)
            part = read_bytes(spark, block.file, block.at + len(head) + low, high - low)
            found.append(unpack_from_bit(part, width, a * width - 8 * low, b - a).tolist())
    return found


def with_starts(read: DataFrame) -> DataFrame:
    """start: ids of all documents before it. Totals are one row a shard, as many as partitions at most."""
    totals = read.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return read.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document."""
    from docforge.llm.common import table

    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    try:
        read = cut(read_token_files(spark, path))
    finally:
        remove(spark, path)
    return with_starts(read)
