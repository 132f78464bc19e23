"""Words of many texts at once: boundaries and 64-bit hashes from a few array passes over the bytes.

A word is a run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing.  Every byte of a non-ASCII
character is 0x80 or more, so the bytes can be classed one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd base of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = True
IS_WORD[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POW, _INV = _powers(BASE, CHUNK), _powers(INVERSE, CHUNK)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that the order of hashes is unrelated to the words."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass
class Words:
    """Words in order; ``row`` is the text's index, ``start`` and ``end`` are positions in ``data`` (lower-cased bytes)."""

    data: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``longest`` bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        return mixed((self._prefix(end) - self._prefix(self.start)) * self._power(INVERSE, _INV, self.start))

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.row, minlength=len(self.offsets) - 1)

    def _power(self, base: int, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        high = np.array([pow(base, CHUNK * i, 1 << 64) for i in range(len(self.data) // CHUNK + 2)], dtype=_U)
        return table[at % CHUNK] * high[at // CHUNK]

    def _prefix(self, at: np.ndarray) -> np.ndarray:
        """Sum of byte * BASE**position before each of the ascending positions ``at``, chunk by chunk."""
        out, carry = np.empty(len(at), dtype=_U), _U(0)
        for i, lo in enumerate(range(0, len(self.data) + 1, CHUNK)):
            part = self.data[lo : lo + CHUNK]
            sums = np.zeros(len(part) + 1, dtype=_U)
            np.cumsum((part.astype(_U) + _U(1)) * _POW[: len(part)], out=sums[1:])
            sums = sums * _U(pow(BASE, CHUNK * i, 1 << 64)) + carry
            a, b = np.searchsorted(at, (lo, lo + CHUNK))
            out[a:b] = sums[at[a:b] - lo]
            carry = sums[-1]
        return out


def split(texts: pa.Array, inside_word: np.ndarray = IS_WORD) -> Words:
    """The words of every text; ``inside_word`` says which bytes belong to one."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = inside_word[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    if len(raw):
        edge[0], edge[-1] = inside[0], inside[-1]
        edge[1:-1] = inside[1:] != inside[:-1]
    # a text's end also ends its last word: where words touch the border, cut there
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(raw))])
    touching = inner[inside[inner] & inside[inner - 1]] if len(inner) else inner
    at = np.flatnonzero(edge)
    if len(touching):
        at = np.sort(np.concatenate([at, touching, touching]))
    start, end = at[::2], at[1::2]
    return Words(LOWER[raw], raw, offsets, np.searchsorted(offsets, start, side="right") - 1, start, end)
