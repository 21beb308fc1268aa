"""Texts cut into pre-tokens where a tokenizer cuts too, and a compact table of what is known of them.

Texts are handled as bytes, many at a time: places to cut are found by comparing bytes, and a
pre-token is known by a 64-bit hash. (Two different ones that a worker meets share it with a chance
of N * N / 2**65 for N of them.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sparkqueue.llm import common

U64 = np.uint64
#: Pre-tokens that are looked up at once.
AT_ONCE = 1 << 19

#: Classes of bytes, as bits: space, line end, white space, other characters of one byte, letters of one byte, and
#: the marks that are cut from letters. Characters of two bytes are none of them white space from lead byte C3 on, and
#: letters as far as C8, but for two signs under C3 that end as no letter here may.
SPACE, LINE_END, WHITE, PLAIN, LETTER, MARK, LEAD, LETTER_LEAD = (np.uint8(1 << k) for k in range(8))
_BYTES = np.arange(256)
_WHITE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
CLASS = np.zeros(256, np.uint8)
for _bit, _of in (
    (SPACE, _BYTES == 32),
    (LINE_END, _BYTES == 10),
    (WHITE, _WHITE),
    (PLAIN, (_BYTES < 128) & ~_WHITE),
    (LETTER, (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122)),
    (MARK, (_BYTES == 44) | (_BYTES == 46)),
    (LEAD, (_BYTES >= 0xC3) & (_BYTES <= 0xDF)),
    (LETTER_LEAD, (_BYTES >= 0xC3) & (_BYTES <= 0xC8)),
):
    CLASS[_of] |= _bit


def byte_level_cuts(data: np.ndarray) -> np.ndarray:
    """Where white space follows something else, and a full stop or comma a letter: there the byte-level pattern cuts too.

    Only characters of one byte and some of two are looked at, so a cut is never beside other white space.
    """
    padded = np.concatenate((np.zeros(2, np.uint8), CLASS[data]))
    now, before, lead = padded[2:], padded[1:-1], padded[:-2]
    out = (now & WHITE).astype(bool) & ((before & PLAIN | lead & LEAD) != 0)
    marks = np.flatnonzero(now & MARK)
    own = np.maximum(marks - 1, 0)
    out[marks] = (before[marks] & LETTER).astype(bool) | (lead[marks] & LETTER_LEAD).astype(bool) & (data[own] != 0x97) & (data[own] != 0xB7)
    return out


def piece_cuts(data: np.ndarray) -> np.ndarray:
    """Before each run of spaces, and before and after each line end."""
    padded = np.concatenate((np.zeros(1, np.uint8), CLASS[data]))
    now, before = padded[1:], padded[:-1]
    return (now & LINE_END | before & LINE_END | now & ~before & SPACE) != 0


def cut(data: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the pre-tokens of all rows and, per row, the index of its first one (one more at the end)."""
    begins = cuts.copy()
    begins[starts[:-1][starts[:-1] < len(data)]] = True
    first = np.flatnonzero(begins)
    return first, np.searchsorted(first, starts)


def groups(first: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pre-tokens AT_ONCE at a time: the index of the first one, first bytes and ends."""
    for at in range(0, len(first), AT_ONCE):
        some = first[at : at + AT_ONCE + 1]
        yield at, some[:AT_ONCE], some[1:] if len(some) > AT_ONCE else np.append(some[1:], n)


class Known:
    """Hash -> a value of a fixed type, as two arrays in the hashes' order; grows up to ``most`` entries."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, most: int):
        order = np.argsort(hashes)
        self.hashes, self.values, self.most = hashes[order].astype(U64), values[order], most

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is there, and its value (or any)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), self.values.dtype)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.values[at]

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Take in new ones (ascending), as many as there is room for; which these are, hashes decide."""
        if room := min(len(hashes), self.most - len(self.hashes)):
            at = np.searchsorted(self.hashes, hashes[:room])
            self.hashes, self.values = np.insert(self.hashes, at, hashes[:room]), np.insert(self.values, at, values[:room])


def distinct(data: np.ndarray, first: np.ndarray, end: np.ndarray, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of some pre-tokens, ascending, where each first is, and each one's place among them."""
    return np.unique(common.byte_hashes(data, first, end, key), return_index=True, return_inverse=True)
