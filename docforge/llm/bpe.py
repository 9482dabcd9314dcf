"""BPE encoding and decoding by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be merged over: the place between them is a
certain cut. A table of 65,536 bits marks those pairs. Words (the matches of the split pattern) are cut wherever the
table says so, each fragment is merged on its own, and the ids are concatenated; fragments and words are remembered.
Whole texts are cut the same way before the pattern runs, at pairs (byte, space) that are forced and where the pattern
provably begins a match (see vocab.py); a text with other white space beside a space goes through the pattern whole, in
time and memory in proportion to it.

Special strings of the file are taken first, as the library does by default. Decoding concatenates the tokens' bytes
and reads them as UTF-8, with U+FFFD for what isn't.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows are encoded one by one;
null ids of documents stay; an empty table gives no rows. No shuffle; a worker's memory is bounded by its caches, one
Arrow batch and one document.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import resident
from docforge.llm.vocab import BYTE_BPE, WordTable, byte_letters, forced_pairs, splits_at_spaces, tokenizer_path

#: Fixed value: the split pattern of byte-level BPE files that say use_regex.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
REMEMBERED_PARTS, REMEMBERED_WORDS = 50_000, 400_000
SCAN = 48  # longer fragments are merged with a heap


class ForcedBoundaryBPE:
    def __init__(self, name: str = BYTE_BPE):
        with open(tokenizer_path(name), encoding="utf-8") as f:
            conf = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = conf["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in conf.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.tokens[i] = raw(token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[int, int] = {}  # of a pair of ids, (a << 32 | b)
        self.made: list[int] = []  # by rank
        for pair in conf["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        self.forced_bytes = forced_pairs(self.tokens).tobytes()
        self.by_words = splits_at_spaces(name)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.parts: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.cache = WordTable(lambda texts: list(map(self.encode_plain, texts)), lambda words: list(map(self.encode_plain, words)), self.by_words, REMEMBERED_WORDS)

    def merge(self, fragment: bytes) -> bytes:
        """Ids of a fragment that has no certain cut."""
        ids = [self.byte_id[b] for b in fragment]
        if len(ids) > SCAN:
            return self._merge_long(ids)
        find, none = self.rank.get, 1 << 60
        ranks = [find(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            ids[at : at + 2] = [self.made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = find(ids[at - 1] << 32 | ids[at], none)
            if at < len(ranks):
                ranks[at] = find(ids[at] << 32 | ids[at + 1], none)
        return np.asarray(ids, "<u4").tobytes()

    def _merge_long(self, ids: list[int]) -> bytes:
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (rank := self.rank.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return np.asarray([x for x in ids if x >= 0], "<u4").tobytes()

    def cut(self, word: bytes) -> list[bytes]:
        """The word, cut at every pair that occurs inside no token."""
        forced, out, start = self.forced_bytes, [], 0
        for i in range(1, len(word)):
            if forced[word[i - 1] << 8 | word[i]]:
                out.append(word[start:i])
                start = i
        return [*out, word[start:]]

    def encode_word(self, word: str) -> bytes:
        made = []
        for part in self.cut(word.encode()):
            ids = self.parts.get(part)
            if ids is None:
                ids = self.merge(part)
                if len(self.parts) < REMEMBERED_PARTS and len(part) < 64:
                    self.parts[part] = ids
            made.append(ids)
        return b"".join(made)

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text that is split by the pattern; special strings first."""
        out = []
        for i, piece in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if i % 2:
                out.append(np.asarray([self.special[piece]], "<u4").tobytes())
                continue
            for word in PATTERN.findall(piece):
                ids = self.words.get(word)
                if ids is None:
                    ids = self.encode_word(word)
                    if len(self.words) < REMEMBERED_PARTS and len(word) < 64:
                        self.words[word] = ids
                out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.cache.ids(texts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(name: str = BYTE_BPE) -> ForcedBoundaryBPE:
    return resident(("codec", name), lambda: ForcedBoundaryBPE(name))


def encode_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """doc_id, ids array<int>, n_tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docforge.llm.common import slices, texts_of

        bpe = codec(tokenizer)
        for batch in slices(batches):
            made = [np.frombuffer(x, "<i4") for x in bpe.encode(texts_of(batch.column(1)))]
            ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made) if made else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.diff(ends), pa.int64())], ["doc_id", "ids", "n_tokens"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"doc_id {kind}, ids array<int>, n_tokens bigint")


def decode_documents(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", tokenizer: str = BYTE_BPE) -> DataFrame:
    """doc_id, text: null ids give the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docforge.llm.common import slices

        bpe = codec(tokenizer)
        for batch in slices(batches):
            made = [bpe.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(decode, f"doc_id {kind}, text string")


def round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docforge.llm.common import slices, texts_of

        bpe = codec(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches):
            made = bpe.encode(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(list(map(sha, made)), pa.string()), pa.array([sha(bpe.decode(x).encode()) for x in made], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document."""
    from docforge.llm.common import table

    return round_trip(table(spark, sf_dir, "documents"))
