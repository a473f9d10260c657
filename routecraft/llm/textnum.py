"""Texts as numpy arrays: code points, words and rolling hashes of whole blocks.

A block holds many whole texts, each followed by a blank, so that one vector
operation serves all of them; one text longer than the block size makes a block
of its own. Hashes are 64-bit prefix sums of powers (a rolling hash): the hash
of any span is one subtraction and one multiplication.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLOCK_CHARS = 1 << 20
_U = np.uint64
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so both have an inverse modulo 2**64
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(n, BLOCK_CHARS + 2), base, _U)]), dtype=_U)
        _POWERS[base] = have
    return have[:n]


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of values[i] * base**i; len(values) + 1 entries."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(base, len(values)), dtype=_U, out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[start:end], equal for equal contents and lengths."""
    inverse = pow(base, -1, 1 << 64)
    body = (pre[end] - pre[start]) * powers(inverse, len(pre) + 1)[start]
    return mix(body + (end - start).astype(_U) * _U(0xA0761D6478BD642F))


def blocks(texts: list[str], limit: int = BLOCK_CHARS):
    """Slices of ``texts`` of at most ``limit`` code points (one text at least)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) + 1 > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


class Block:
    """Code points of whole texts, each followed by a blank."""

    def __init__(self, texts: list[str], fold: bool = False):
        self.n = len(texts)
        joined = " ".join(texts) + " "
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if fold:  # A-Z to a-z
            self.cp = self.cp + ((self.cp - np.uint32(65) < 26).astype(np.uint32) << np.uint32(5))
        self.length = np.fromiter(map(len, texts), np.int64, self.n)
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)[:-1]]) if self.n else np.zeros(0, np.int64)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, positions, "right") - 1

    def char_prefix(self) -> np.ndarray:
        return prefix(mix(self.cp.astype(_U) + _U(1)))

    def blank_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of [^\\x20\\x09-\\x0D]+ as starts and ends."""
        return runs((self.cp != 32) & (self.cp - np.uint32(9) > 4))

    def alnum_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ (of folded text) as starts and ends."""
        return runs(_ALNUM[np.minimum(self.cp, 128)])


_ALNUM = np.ones(129, bool)
_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def ngrams(word_hash: np.ndarray, doc: np.ndarray, n: int, pre: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-word windows that stay in one text, and their hashes."""
    if len(word_hash) < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1:])
    pre = prefix(word_hash, _BASE2) if pre is None else pre
    return at, span_hash(pre, at, at + n, _BASE2)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
