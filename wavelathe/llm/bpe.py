"""Exact, cached encoding with the public tokenizers' vocabularies.

A text falls into chunks at blanks, and no token crosses one, so ids of chunks
are kept and joined. Chunks of plain Latin letters, digits and marks are split
by the vocabulary's own pattern and merged by the tokenizers library's model;
all other chunks go through the library's whole encoder.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from .common import KEPT

_MOST = 400_000  # chunks of a generation; a worker keeps two: some 150 MB
_LONG = 64  # longer chunks are not kept
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ſ]+").fullmatch
_ODD_BLANK = re.compile(r" \s").search
_BLANK_SPLIT = re.compile(r" (?=\S)").split


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """Results of make by key. A full generation becomes the old one, so that what is in use stays."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= _LONG:
            if len(self) >= _MOST:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Encoder:
    """ids of texts as little-endian bytes of `dtype`, as the library's encode gives them without added tokens.

    The strings of special tokens in a text become those tokens, as the library
    has it; with special_as_text they are ordinary text.
    """

    # The two vocabularies' own patterns.
    PATTERNS = {
        "byte_bpe_50k.json": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
        "word_bpe_49k.json": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    }

    def __init__(self, name: str, path: str | None = None, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The library may look for added strings in the lower-cased text.
        self.special = re.compile("|".join(added), re.IGNORECASE).search if added else None
        self.size = self.tokenizer.get_vocab_size()
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.byte_level = name.startswith("byte")
        self.letters = _byte_letters()
        self.blank = " " if self.byte_level else ""
        self.model = self.tokenizer.model
        self.find = regex.compile(self.PATTERNS[name]).findall
        self.words = _Kept(self._word)
        self.chunks = _Kept(self._chunk)

    def _word(self, w: str) -> bytes:
        if w.isascii() and w.isalpha():
            mapped = w
        else:
            mapped = w.encode().decode("latin1").translate(self.letters)
        return self._ids(mapped)

    def _ids(self, mapped: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        # A line end begins a chunk of its own, with no blank before it.
        blank = "" if chunk[:1] == "\n" else self.blank
        if not _PLAIN(chunk):
            return self.whole(blank + chunk)
        if not self.byte_level:
            chunk = chunk.lower()
        if chunk.isalpha():
            if chunk.isascii() and self.byte_level:
                return self._ids("Ġ" + chunk)
            return self._word(self.blank + chunk)
        # Letters and one mark behind them: the letters are a chunk of their own.
        stem, last = chunk[:-1], chunk[-1]
        if stem.isalpha() and not last.isspace():
            return self.chunks[stem] + self.words[last]
        return b"".join([self.words[w] for w in self.find(blank + chunk)])

    def encode(self, text: str | None) -> bytes:
        """ids of the whole text; of none, null or empty, no bytes."""
        if not text:
            return b""
        if self.special and self.special(text):
            return self.whole(text)
        if not self.byte_level:
            # Blanks and line ends both only part words here.
            return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        if _ODD_BLANK(text):
            first, *rest = _BLANK_SPLIT(text)
        else:
            *lines, _ = text.split("\n")
            if lines and all(x and not x[-1].isspace() for x in lines):
                text = text.replace("\n", " \n")
            first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.chunks.__getitem__, rest))


def encoder(name: str, path: str | None = None, special_as_text: bool = False) -> Encoder:
    """This worker's encoder, kept until another operator's task runs in the worker."""
    key = name, path, special_as_text
    if key not in KEPT:
        KEPT[key] = Encoder(*key)
    return KEPT[key]
