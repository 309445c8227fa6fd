"""Words and their hashes, found in numpy over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than space and 0x09-0x0D.  The hash of a byte run is made of
two polynomials over random tables of byte values, one modulo 2**64 and one modulo the prime 2**31-1:
strings such as the Thue-Morse words, which any base modulo a power of two confuses, differ in the
second.  One running sum serves every run: ``(sum[end] - sum[start]) * base**-start``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIME = (1 << 31) - 1
_PRIME_BASE = 0x5851F42D
_PRIME_INVERSE = pow(_PRIME_BASE, -1, _PRIME)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:  # each step doubles what is there
        more = min(have, n - have)
        out[have:have + more] = out[:more] * U(pow(base, have, _PRIME)) % U(_PRIME)
        have += more
    return out[:n]


class Powers:
    """Powers of both bases and of their inverses, grown as longer blocks come."""

    def __init__(self) -> None:
        self._all = (np.empty(0, np.uint64),) * 4

    def upto(self, n: int) -> tuple[np.ndarray, ...]:
        """Up and down modulo 2**64, up and down modulo the prime."""
        if len(self._all[0]) < n:
            self._all = (_powers(_BASE, n), _powers(_INVERSE, n), _prime_powers(_PRIME_BASE, n), _prime_powers(_PRIME_INVERSE, n))
        return tuple(x[:n] for x in self._all)


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_BYTE_PRIME = BYTE_VALUE % U(_PRIME)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """Words of one block: byte ranges, index of their text and 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


class Block:
    """Texts of one block of bytes, with what the operators ask of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: Powers, lower: bool = False) -> None:
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        up, self._down, prime_up, self._prime_down = powers.upto(len(data) + 1)
        self._sum, self._prime_sum = np.zeros((2, len(data) + 1), np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[:-1], out=self._sum[1:])
        np.cumsum(_BYTE_PRIME[data] * prime_up[:-1] % U(_PRIME), out=self._prime_sum[1:])  # exact below 2**33 bytes

    def run_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        prime = (self._prime_sum[end] - self._prime_sum[start]) % U(_PRIME) * self._prime_down[start] % U(_PRIME)
        return mix(((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64)) ^ mix(prime + U(1)))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def inside(self) -> np.ndarray:
        return ~IS_SPACE[self.data]

    def words(self) -> Words:
        inside = self.inside()
        if not len(inside):
            none = np.empty(0, np.int64)
            return Words(none, none, none, np.empty(0, np.uint64))
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return Words(start, end, self.doc_of(start), self.run_hash(start, end))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each ``\\n``-split line."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.offsets[:-1], breaks + 1])
        doc = np.concatenate([np.arange(self.n_docs), self.doc_of(breaks)])
        at = np.searchsorted(breaks, start)
        following = np.append(breaks, len(self.data))[at]
        return start, np.minimum(following, self.offsets[1:][doc]), doc


def per_doc(doc: np.ndarray, n_docs: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Count, or exact integer sum of ``weight``, by text."""
    if weight is None:
        return np.bincount(doc, minlength=n_docs).astype(np.int64)
    total = np.zeros(n_docs, np.int64)
    np.add.at(total, doc, weight)
    return total


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: positions of all members of groups of two or more, and of all but the first."""
    if not len(key):
        none = np.empty(0, np.int64)
        return none, none
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.append(False, same)
    return order[later | np.append(same, False)], order[later]


def windows(words: Words, n: int, rolling: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of the n-word windows from that of the (n-1)-word ones, and which lie in one text."""
    if n == 1 or rolling is None:
        rolling = words.hash
        return rolling, np.ones(len(rolling), bool)
    if len(words.hash) < n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    rolling = rolling[:len(words.hash) - n + 1] * U(_BASE) + words.hash[n - 1:]
    return rolling, words.doc[:len(rolling)] == words.doc[n - 1:]
