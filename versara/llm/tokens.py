"""Exact, memoised encoding with the public tokenizers.

Both vocabularies cut a text into pieces before any merge, and no merge crosses a piece. The ids of a
text are therefore the ids of its pieces, one after another, and natural text repeats its pieces. A
worker keeps the ids of the pieces that it has met, in two generations of at most ``limit`` (when the young
one is full it becomes the old one, and what is met again moves over; this changes the time and never the
ids). Texts in which the cheap cut could differ from the tokenizer's own go through the tokenizer whole.
Texts of plain characters need no memory under the word vocabulary: one call takes all their words through
the merges.
"""

from __future__ import annotations

import array
import json
import re
import sys
import unicodedata

import numpy as np

_OPEN: dict[tuple, object] = {}
_DOUBLE = re.compile(r"\s\s")
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x85]")
_PLAIN = re.compile("[\x20-\x7e\xa1-įı-ɏ–—‘’“”…€]*")
_PLAIN_TEXT = re.compile(f"[\t-\r{_PLAIN.pattern[1:-2]}]*")
#: Characters that are cut off by spaces around them, as long as no two marks meet; an apostrophe may open a piece.
_DIGITS, _MARKS = "0123456789", "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~–—‘’“”…€"
_SIMPLE = re.compile(f"[\t-\r {re.escape(_DIGITS + _MARKS)}{''.join(c for c in map(chr, range(0x250)) if c.isalpha() and _PLAIN.fullmatch(c))}]*")
_RUN = re.compile(f"[{re.escape(_MARKS)}]{{2}}")
_SPACED = [(c, f" {c} ") for c in _DIGITS + _MARKS] + [(c, " ") for c in "\t\n\v\f\r"]


if array.array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 32-bit numbers")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``encode(text)`` gives the ids of a text as unsigned 32-bit numbers, as the tokenizers library does
    with add_special_tokens=False."""

    def __init__(self, path: str, limit: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.limit, self.memo, self.old = limit, {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        kind = (spec["model"].get("end_of_word_suffix"), (spec.get("pre_tokenizer") or {}).get("type"), (spec.get("normalizer") or {}).get("type"))
        self.piece = self.merge = None
        if kind == (None, "ByteLevel", None):
            self._open_byte_level(spec)
        elif kind == ("</w>", "Sequence", "Sequence"):
            self._open_words(spec)

    def _open_byte_level(self, spec: dict) -> None:
        vocab = spec["model"]["vocab"]
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return  # ids don't follow the merges' order: the tokenizer itself encodes everything
        import public_tokenizers
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece, self.cut, self.plain = coder.encode_ordinary, self._spaces, lambda letters: letters

    def _open_words(self, spec: dict) -> None:
        import regex

        pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = {i: c for i, c in byte_letters().items()}
        model = self.whole.model

        def piece(chunk: str) -> list[int]:
            if not _PLAIN.fullmatch(chunk) or "<|" in chunk:
                return self.whole.encode(chunk, add_special_tokens=False).ids
            out: list[int] = []
            for word in pattern.findall(unicodedata.normalize("NFC", chunk).lower()):
                out += [t.id for t in model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(letters))]
            return out

        # letters alone, of a range in which lower-casing goes character by character
        self.piece, self.cut, self.plain = piece, self._words, lambda letters: letters.lower() if _PLAIN.fullmatch(letters) else None
        self.pieces = pattern.findall
        self._open_merges(spec["model"])

    def _open_merges(self, model: dict) -> None:
        """The word vocabulary by its ranks. A space, which no word holds, closes each word: it joins the word's
        last byte before anything else, as the ids of the 256 closing bytes are below those of all merges."""
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        back = {c: bytes([b]) for b, c in byte_letters().items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if {vocab.get(c) for c in back} != {*range(256)} or {vocab.get(c + suffix) for c in back} != {*range(256, 512)} or any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)):
            return  # ids don't follow the merges' order: the tokenizer's own model takes each word
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return
        import tiktoken

        ranks = {b"".join(back[c] for c in t.removesuffix(suffix)) + b" " * t.endswith(suffix): i for t, i in vocab.items() if t not in self.special}
        self.merge = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def _spaces(self, text: str) -> list[str] | None:
        """Single spaces open a piece, single line ends are pieces: so do the vocabulary's own rules cut
        if no two white-space characters meet and none stands at an end."""
        if _DOUBLE.search(text) or text[:1].isspace() or text[-1:].isspace() or "\x01" in text or any(s in text for s in self.special):
            return None
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def _words(self, text: str) -> list[str] | None:
        return None if _ODD.search(text) else text.split()

    def _closed(self, text: str) -> str | None:
        """The words of a plain text, a space after each. Plain characters are in normal form and lower-case one
        by one."""
        if _SIMPLE.fullmatch(text) and not _RUN.search(text):
            text = text.lower()
            for c, spaced in _SPACED:
                text = text.replace(c, spaced)
            return text + " "
        if not _PLAIN_TEXT.fullmatch(text) or "<|" in text:
            return None
        return " ".join(self.pieces(text.lower())) + " "

    def raw(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.merge and (closed := self._closed(text)) is not None:
            return self.merge(closed, disallowed_special=()).astype("<u4", copy=False).tobytes()
        chunks = self.cut(text) if self.piece else None
        if chunks is None:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        found = [*map(self.memo.get, chunks)]
        if None in found:
            for i, got in enumerate(found):
                if got is None:
                    found[i] = self._find(chunks[i])
        return b"".join(found)

    def _find(self, chunk: str) -> bytes:
        """The ids of a chunk: remembered, or those of its letters and of the mark after them (which is
        always a piece of its own), or encoded."""
        if (got := self.memo.get(chunk)) is not None:
            return got
        if (got := self.old.get(chunk)) is None:
            core, mark = (chunk[:-1], chunk[-1]) if len(chunk) > 1 and chunk[-1] in ",.;:!?" else (chunk, "")
            if core.lstrip(" ").isalpha() and (key := self.plain(core)) not in (None, chunk):
                got = self._find(key) + (self._find(mark) if mark else b"")
            else:
                got = array.array("I", self.piece(chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self.memo) >= self.limit:
                self.old, self.memo = self.memo, {}
            self.memo[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), dtype="<u4")


def encoder(path: str, limit: int = 150_000) -> Encoder:
    """The worker's encoder of a vocabulary file; opened once in each worker."""
    if (path, limit) not in _OPEN:
        _OPEN[path, limit] = Encoder(path, limit)
    return _OPEN[path, limit]
