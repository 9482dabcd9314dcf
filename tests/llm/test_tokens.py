"""op3, op5 and op7 against the library, and their files."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from docforge.llm import bpe, token_counts, token_files
from docforge.llm.vocab import BYTE_BPE, cached_library, library

from tests.llm.fixtures import AWKWARD, documents, prose

PIECES = [" ", "  ", "\n", "\t", "a", "the", " the", "'s", "'ll", "é", "ß", "1", "23", ".", "!!", "<|endoftext|>", "\u00a0", "\x85", "\x1c", "日本", "\U0001f642", "_", "-", "A" * 70, "ab" * 40]


def ids_of(text):
    return library(BYTE_BPE).encode(text or "", add_special_tokens=False).ids


def strings(n, most, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("encode", [lambda t: bpe.codec().encode(t), lambda t: cached_library(BYTE_BPE).ids(t)])
def test_ids_are_the_librarys(encode):
    texts = strings(2000, 40)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [ids_of(t) for t in texts]


def test_every_code_point_is_split_as_the_library_does():
    codec, own = bpe.codec(), library(BYTE_BPE)
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 256):
        text = "".join(f"a{c}b  {c}{c} 1{c}" for c in points[at : at + 256])
        assert np.frombuffer(codec.encode_plain(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_forced_cuts_are_in_no_token():
    codec = bpe.codec()
    for token in codec.tokens[:5000]:
        assert codec.cut(token) == [token]


def test_long_fragments_merge_like_short_ones():
    codec = bpe.codec()
    for text in strings(300, 30, 5):
        raw = text.encode()
        if raw and len(codec.cut(raw)) == 1:
            assert codec._merge_long([codec.byte_id[b] for b in raw]) == codec.merge(raw)


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 16), (37, 3), (1000, 500)])
def test_overlap_resynchronisation(chunk, overlap):
    for text in [*strings(80, 500, 2), "x" * 5000, prose(3, 3000), " " * 3000, ""]:
        assert token_counts.count_huge(text, library(BYTE_BPE), chunk, overlap) == len(ids_of(text))


def test_counts_and_round_trip_of_awkward_rows(spark):
    df = documents(spark, AWKWARD)
    want = sorted((str(i), len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 512) for i, t, _ in AWKWARD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df).collect()) == want
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids_of(t)), sha(np.asarray(ids_of(t), "<u4").tobytes()), sha(library(BYTE_BPE).decode(ids_of(t), skip_special_tokens=False).encode())) for i, t, _ in AWKWARD)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df).collect()) == want
    back = bpe.decode_documents(bpe.encode_documents(df))
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((i, t or "")) for i, t, _ in AWKWARD)


@pytest.mark.parametrize("width", [1, 3, 7, 8, 11, 16, 17, 20, 31, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 70_003, dtype=np.uint64).astype("<u4")
    packed = token_files.pack(ids, width)
    assert len(packed) == (len(ids) * width + 7) // 8
    assert (token_files.unpack(packed, width, 0, len(ids)) == ids).all()
    assert (token_files.unpack(packed, width, 12_345, 777) == ids[12_345 : 12_345 + 777]).all()


def test_width_of():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


def test_token_files(spark, tmp_path):
    rows = [*AWKWARD, *((i, prose(i, 30), "en") for i in range(100, 160))]
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(documents(spark, rows), path, block_ids=500, blocks_a_file=3)
    got = token_files.with_starts(token_files.read_token_files(spark, path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(ids_of(t)) + 1, zlib.crc32(np.asarray([*ids_of(t), 0], "<u4").tobytes())) for i, t, _ in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered[:-1])]).tolist()
    named = [r.doc_id for r in ordered]
    assert named[0] is None and named[1:] == sorted(named[1:])
    token_files.index_token_files(spark, path)
    assert token_files.read_document(spark, path, 120) == [[*ids_of(prose(120, 30)), 0]]
    assert len(token_files.read_document(spark, path, 4)) == 2


def test_empty_tables(spark, tmp_path):
    empty = documents(spark, AWKWARD).where("1 = 0")
    assert token_counts.count_tokens(empty).count() == 0
    assert bpe.round_trip(empty).count() == 0
    token_files.write_token_files(empty, f"file://{tmp_path}/tokens")
    assert token_files.with_starts(token_files.read_token_files(spark, f"file://{tmp_path}/tokens")).count() == 0


def test_ids_do_not_depend_on_fragments(monkeypatch):
    monkeypatch.setattr("docforge.llm.vocab.FRAGMENT", 50)
    texts = [prose(9, 200), *strings(50, 60, 7)]
    assert [len(x) // 4 for x in cached_library(BYTE_BPE).ids(texts)] == [len(ids_of(t)) for t in texts]


class Counting:
    """The library, counting the characters that it is given."""

    def __init__(self):
        self.own, self.characters = library(BYTE_BPE), 0

    def encode(self, text, **more):
        self.characters += len(text)
        return self.own.encode(text, **more)

    def __getattr__(self, name):
        return getattr(self.own, name)


def unspaced(kind, n):
    rng = random.Random(1)
    if kind == "base64":
        return "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    if kind == "han":
        return "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    return {"one letter": "a" * n, "code": "a.b(c){d=e;f['g']='h'}" * (n // 22), "signs": "=-" * (n // 2), "special": "<|endoftext|>x'll" * (n // 17), "blanks": " " * n, "letters": "abcdefg" * (n // 7)}[kind]


@pytest.mark.parametrize("kind", ["base64", "han", "one letter", "code", "signs", "special", "blanks", "letters"])
def test_counting_is_linear_without_spaces(kind):
    for n in (20_000, 40_000):
        text, own = unspaced(kind, n), Counting()
        assert token_counts.count_huge(text, own, 1000, 64) == len(ids_of(text))
        assert own.characters <= 8 * len(text)


def test_proven_places_begin_tokens():
    """Text encoded in two at a proven place gives the ids of the whole."""
    from docforge.llm.vocab import forced_of, proven_places

    rng = random.Random(4)
    for text in [*strings(300, 12, 11), "x's 'll a'b 'sam ''re", "<|endoftext|>a<|endoftext|>", unspaced("han", 60)]:
        for p in rng.sample(places, min(6, len(places))) if (places := list(proven_places(text, 0, len(text), forced_of(BYTE_BPE), ["<|endoftext|>"]))) else []:
            assert ids_of(text[:p]) + ids_of(text[p:]) == ids_of(text), (text, p)


def test_piece_models_count_and_write(spark, tmp_path):
    from docforge.llm.vocab import tokenizer_path

    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = [r for r in AWKWARD if r[0] != 6]
    df = documents(spark, rows)
    want = sorted((str(i), len(own.encode(t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(df, tokenizer="piece_bpe_32k.model").collect()) == want
    token_files.write_token_files(df, f"file://{tmp_path}/pieces", tokenizer="piece_bpe_32k.model", end_id=2)
    assert sorted((str(r.doc_id), r.n_tokens - 1) for r in token_files.read_token_files(spark, f"file://{tmp_path}/pieces").collect()) == want


def test_a_full_table_begins_anew(monkeypatch):
    own = cached_library(BYTE_BPE)
    own.clear()
    monkeypatch.setattr(own, "most", 30)
    for text in [*(prose(i, 12) for i in range(30)), "the same words the same words", "x" * 600_000 + " y", "\n".join(prose(5, 90).split()), prose(7, 150_000)]:
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == ids_of(text)
    own.clear()


def test_many_words_and_texts_at_once():
    texts = [prose(i, 400).replace(" the ", "\n") + f" w{i} w{i}a{i * i}" for i in range(300)] + strings(300, 30, 3)
    assert [np.frombuffer(x, "<u4").tolist() for x in cached_library(BYTE_BPE).ids(texts)] == [ids_of(t) for t in texts]
