"""64-bit hashes of words and of word shingles, for many texts at a time."""

from __future__ import annotations

import numpy as np

from .common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(65535, _BASE, np.uint64)]), dtype=np.uint64)
#: White space of the word rule: a blank and code points 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PIECE = 1 << 20


def pieces(raw: bytes):
    """Cut a long text at white space into parts of about a megabyte."""
    at = 0
    while len(raw) - at > PIECE:
        cut = max(raw.rfind(b" ", at, at + PIECE), raw.rfind(b"\n", at, at + PIECE))
        if cut <= at:
            nexts = [x for x in (raw.find(b" ", at + PIECE), raw.find(b"\n", at + PIECE)) if x >= 0]
            if not nexts:
                break
            cut = min(nexts)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def words_at(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each word of the bytes, ASCII letters in lower case."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    none = np.empty(0, np.uint64)
    if not len(b):
        return none.astype(np.int64), none, none
    inside = ~_SPACE[b]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return starts, none, none
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(b)]])))
    value = (b.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 65535]
    value[~inside] = 0
    length = np.add.reduceat(inside, starts, dtype=np.uint64)
    return starts, length, mix64(np.add.reduceat(value, starts) ^ (length * _STEP))


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's number of words."""
    if len(raws) == 1 and len(raws[0]) > PIECE:
        parts = [words_at(p)[2] for p in pieces(raws[0])]
        out = np.concatenate(parts)
        return out, np.array([len(out)])
    starts, _, hashes = words_at(b" ".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))


def shingle_sets(raws: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one for a shorter text, none for no words."""
    hashes, counts = word_hashes(raws)
    if not len(hashes):
        return [hashes[:0]] * len(raws)
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * _BASE + hashes[k : k + len(rolled)]
    rolled = mix64(rolled)
    out, at = [], 0
    for n in counts:
        if n >= words:
            s = np.sort(rolled[at : at + n - words + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in hashes[at : at + n]:
                    h = h * _STEP + w
            s = mix64(np.array([h]))
        else:
            s = hashes[:0]
        out.append(s)
        at += n
    return out
