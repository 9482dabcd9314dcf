"""Ways into a public tokenizer file: the library itself, and the same ids faster by remembering words.

A single space between two characters that are not white space is a proven place to cut for byte-level BPE with the
usual split pattern: no match of the pattern that holds a non-space character goes on over a space, and a match that
starts at the space depends on nothing before it; so is the place before a single line end between such characters.
``WordTable`` cuts texts there, lets the library encode the words it has not met, and puts their ids together in numpy.

So are other places (``proven_places``): where a letter, digit or ASCII sign is followed by a blank or line end, and where
letters, digits and ASCII signs meet, but behind an apostrophe, which may begin a contraction: every match ends there,
and what begins there depends on nothing before it. Between two letters it is one if no token holds the two bytes that
meet there. No place inside a special string is one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

from docforge.llm.common import resident

BYTE_BPE = "byte_bpe_50k.json"
#: Words that a worker remembers (some 70 bytes each); when so many are, it begins anew.
REMEMBERED = 1_000_000
#: Characters of a text that are split into words at a time, and bytes that are hashed at a time.
FRAGMENT, HASHED = 1 << 17, 1 << 19
#: Longer words (in bytes) are encoded each time.
LONG = 64
#: More than what any of the libraries takes for white space.
TWO_SPACES = re.compile(r"\s\s")
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer where this process runs; a path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Where classes of characters meet, one character back and one ahead (see above).
_MEET = regex.compile(r"(?<=[\p{L}\p{N}!-/:-@\[-`{-~])(?=[ \n\t])|(?<=\p{L})(?=[\p{N}!-/:-@\[-`{-~])|(?<=\p{N})(?=[\p{L}!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[\p{L}\p{N}])")

_LOADED: dict[str, object] = {}


def is_piece_model(name: str) -> bool:
    return name.endswith(".model")


def library(name: str):
    """The library of that file: sentencepiece for .model, else tokenizers; one thread, as Spark runs a worker for each core."""
    if name not in _LOADED and is_piece_model(name):
        from sentencepiece import SentencePieceProcessor

        _LOADED[name] = SentencePieceProcessor(model_file=tokenizer_path(name))
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer_path(name))
        made.no_padding()
        made.no_truncation()
        _LOADED[name] = made
    return _LOADED[name]


def vocabulary_size(name: str) -> int:
    own = library(name)
    return own.get_piece_size() if is_piece_model(name) else own.get_vocab_size(with_added_tokens=True)


def splits_at_spaces(name: str) -> bool:
    """Whether the file is a byte-level BPE for which the proof above holds."""
    if is_piece_model(name):
        return False
    with open(tokenizer_path(name), encoding="utf-8") as f:
        conf = json.load(f)
    split = conf.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in conf.get("added_tokens", []))
    return conf["model"]["type"] == "BPE" and not conf.get("normalizer") and not conf.get("post_processor") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and plain


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """For each pair of bytes (first << 8 | second) whether no token holds it, so that nothing is merged over it."""
    forced = np.ones(1 << 16, bool)
    for token in tokens:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8).astype(np.int64)
            forced[b[:-1] << 8 | b[1:]] = False
    return forced


_FORCED: dict[str, bytes] = {}


def forced_of(name: str) -> bytes:
    if name not in _FORCED:
        letters = byte_letters()
        _FORCED[name] = forced_pairs([bytes(letters[c] for c in t) for t in library(name).get_vocab(with_added_tokens=False) if all(c in letters for c in t)]).tobytes()
    return _FORCED[name]


def proven_places(text: str, start: int, end: int, forced: bytes, special: list[str]) -> Iterator[int]:
    """Places of text[start:end] (with a character before and behind) where it is proven that a token begins."""
    inside = lambda p: any(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in special)
    for m in _MEET.finditer(text, start + 1, end - 1):
        if m.start() > start + 1 and not inside(m.start()):  # the pattern sees nothing before its start
            yield m.start()
    for p in range(start + 1, end - 1):
        a, b = text[p - 1], text[p]
        if a.isalpha() and b.isalpha() and forced[a.encode()[-1] << 8 | b.encode()[0]] and not inside(p):
            yield p


def fragments(text: str, size: int = FRAGMENT) -> list[str]:
    """The text cut at safe spaces, which stay at the head of the next piece; pieces are a little over size."""
    out, at = [], 0
    while len(text) - at > size and (cut := SAFE_CUT.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def single_spaced(text: str) -> bool:
    """Whether white space stands alone everywhere, between characters that are none."""
    return not (text[:1].isspace() or text[-1:].isspace() or TWO_SPACES.search(text))


@lru_cache(maxsize=1)
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Of two odd bases the powers, and those of their inverses, modulo 2 to the 64."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(HASHED + 1, x, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        out.append(tuple(both))
    return out


class WordTable:
    """Ids, as little-endian unsigned 32-bit integers, of whole texts.

    Words (each with the space or line end before it) are found by a 128-bit hash of their bytes in an open table, all
    words of many texts at a time. New ones go to word_ids(list of words); encode(list of strings) encodes what is no
    word: heads of texts, very long words, and texts with other white space beside a space.
    """

    def __init__(self, encode, word_ids, by_words: bool = True, most: int = REMEMBERED):
        self.encode, self.word_ids, self.by_words, self.most = encode, word_ids, by_words, most
        self.clear()

    def clear(self) -> None:
        self.count, self.used = 0, 0
        self.pool, self.ends = np.empty(1 << 12, np.uint32), np.zeros(1 << 10, np.int64)
        self._resize(1 << 11)

    def _resize(self, slots: int) -> None:
        old = (self.h, self.g, self.at) if self.count else None
        self.shift = np.uint64(65 - slots.bit_length())
        self.h, self.g, self.at = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        if old:
            held = old[2] >= 0
            self._insert(*(x[held] for x in old))

    def _insert(self, h: np.ndarray, g: np.ndarray, at: np.ndarray) -> None:
        """Different keys that the table doesn't have."""
        mask, left = len(self.at) - 1, np.arange(len(h))
        slot = (h >> self.shift).astype(np.int64)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = at[left[free]]  # of several for one slot the last stays
            placed = self.at[slot] == at[left]
            own, where = left[placed], slot[placed]
            self.h[where], self.g[where] = h[own], g[own]
            left, slot = left[~placed], (slot[~placed] + 1) & mask

    def _find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for unknown ones."""
        mask, slot = len(self.at) - 1, (h >> self.shift).astype(np.int64)
        held = self.at[slot]
        same = (self.h[slot] == h) & (self.g[slot] == g) & (held >= 0)
        out = np.where(same, held, -1)
        left = np.flatnonzero(~same & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            held = self.at[slot]
            same = (self.h[slot] == h[left]) & (self.g[slot] == g[left]) & (held >= 0)
            out[left[same]] = held[same]
            on = ~same & (held >= 0)
            left, slot = left[on], slot[on]
        return out

    def _add(self, made: list[bytes]) -> np.ndarray:
        """Numbers for new entries of the pool of ids."""
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        ids = np.frombuffer(b"".join(made), "<u4")
        first, n = self.count, self.count + len(made)
        while n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.ends[first + 1 : n + 1] = self.used + np.cumsum(sizes)
        self.count, self.used = n, self.used + len(ids)
        return np.arange(first, n, dtype=np.int32)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of texts, each a run of words; HASHED bytes at most in all."""
        if self.count >= self.most:
            self.clear()
        blob = b"".join(pieces)
        raw = np.frombuffer(blob, np.uint8)
        edges = np.cumsum([0, *map(len, pieces)])
        begins = (raw == 32) | (raw == 10)
        begins[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        wide, keys = raw.astype(np.uint64) + np.uint64(1), []
        for power, inverse in _powers():
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(wide * power[: len(raw)], out=sums[1:])
            key = (sums[ends] - sums[starts]) * inverse[starts]
            keys.append((key ^ (key >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD))
        h, g = keys
        at = self._find(h, g)
        long = ends - starts > LONG
        missing = np.flatnonzero((at < 0) & ~long)
        if len(missing):
            _, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            own = missing[first]
            same = g[missing] == g[own[back]]
            words = [blob[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist())]
            heads = [k for k, w in enumerate(words) if w[0] not in " \n"]
            made = dict(zip(heads, self.encode([words[k] for k in heads])))
            others = [k for k in range(len(words)) if k not in made]
            made.update(zip(others, self.word_ids([words[k] for k in others])))
            numbers = self._add([made[k] for k in range(len(words))])
            if 2 * self.count > len(self.at):
                self._resize(1 << (2 * self.count).bit_length())
            self._insert(h[own], g[own], numbers)
            at[missing[same]] = numbers[back[same]]
            long[missing[~same]] = True
        if long.any():  # entries that no word finds again
            k = np.flatnonzero(long)
            at[k] = self._add(self.encode([blob[a:b].decode() for a, b in zip(starts[k].tolist(), ends[k].tolist())]))
        first, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.cumsum(sizes)
        ids = self.pool[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - upto + sizes, sizes)].tobytes()
        cuts = 4 * np.concatenate([[0], upto])[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.encode(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (k, _), ids in zip(held, self._encode_pieces([piece for _, piece in held]) if held else ()):
                out[k].append(ids)
            held.clear()

        for k, text in enumerate(texts):
            if not single_spaced(text):
                flush()
                size = 0
                out[k] += self.encode([text])
                continue
            for piece in fragments(text) if len(text) > FRAGMENT else [text]:
                raw = piece.encode()
                if size + len(raw) > HASHED:
                    flush()
                    size = 0
                if len(raw) > HASHED:
                    out[k] += self.encode([piece])
                else:
                    held.append((k, raw))
                    size += len(raw)
        flush()
        return [b"".join(x) for x in out]


class PieceLibrary:
    """The same of a sentencepiece model, which has no proven places: whole texts."""

    def __init__(self, own):
        self.own = own

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids, "<u4").tobytes() for ids in self.own.encode(texts, num_threads=1)]


def cached_library(name: str) -> WordTable | PieceLibrary:
    """The ids that the library gives (no special tokens added, special strings inside texts by its default)."""

    def build() -> WordTable | PieceLibrary:
        if is_piece_model(name):
            return PieceLibrary(library(name))
        own, by_words = library(name), splits_at_spaces(name)
        size = np.zeros(own.get_vocab_size(with_added_tokens=True), np.int64)
        special = {t.content for t in own.get_added_tokens_decoder().values()}
        for token, i in own.get_vocab(with_added_tokens=True).items():
            size[i] = len(token.encode()) if token in special else len(token)

        def encode(texts: list[str]) -> list[bytes]:
            return [np.asarray(e.ids, "<u4").tobytes() for e in own.encode_batch_fast(texts, add_special_tokens=False)]

        def word_ids(words: list[str]) -> list[bytes]:
            """The words go to the library as running text; each token's bytes tell which word it is from."""
            out: list[bytes] = []
            for at in range(0, len(words), 512):
                some = words[at : at + 512]
                ids = np.asarray(own.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(w.encode()) for w in some])) + 1
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            return out

        return WordTable(encode, word_ids, by_words)

    return resident(("library", name), build)
