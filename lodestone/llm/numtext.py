"""Texts as numpy arrays: hashes of words and character n-grams without a Python step per word."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C55


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, PIECE + (1 << 14))
            inverse = pow(_BASE, -1, 1 << 64)
            cls.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, U(_BASE))]))
            cls.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, U(inverse))]))
        return cls.up, cls.down


#: Word bytes: ASCII letters, digits and the underscore, and all bytes of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
#: A text longer than this is hashed in pieces that end between words.
PIECE = 1 << 19


class Words:
    """The words of some texts, in lower case: `owner` has each word's text, `hash` its hash, `size` its bytes."""

    def __init__(self, texts: list[str], prefixes: tuple[int, ...] = ()):
        raw = [t.lower().encode("utf-8", "replace") for t in texts]
        parts: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        batch, owners, room = [], [], 0
        for k, b in enumerate(raw):
            at = 0
            while at < len(b):
                end = min(len(b), at + PIECE)
                while end < len(b) and end > at and _WORD[b[end]] and _WORD[b[end - 1]]:
                    end -= 1
                end = end if end > at else min(len(b), at + PIECE)
                batch.append(b[at:end])
                owners.append(k)
                room += end - at
                at = end
                if room >= PIECE:
                    parts.append(self._hash(batch, owners, prefixes))
                    batch, owners, room = [], [], 0
        if batch or not parts:
            parts.append(self._hash(batch, owners, prefixes))
        self.n = len(texts)
        self.owner = np.concatenate([p[0] for p in parts])
        self.hash = np.concatenate([p[1] for p in parts])
        self.prefix = [np.concatenate([p[2][j] for p in parts]) for j in range(len(prefixes))]
        self.first = np.searchsorted(self.owner, np.arange(self.n + 1))

    @staticmethod
    def _hash(batch: list[bytes], owners: list[int], prefixes: tuple[int, ...]):
        buf = np.frombuffer(b"\n" + b"\n".join(batch) + b"\n", np.uint8)
        word = _WORD[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        up, down = _Powers.of(len(buf))
        run = np.concatenate([np.zeros(1, U), np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)])])
        lengths = np.array([len(b) + 1 for b in batch] or [1])
        owner = np.array(owners or [0])[np.searchsorted(np.cumsum(lengths), start - 1, side="right")] if len(start) else np.zeros(0, int)
        whole = mix((run[end] - run[start]) * down[start])
        pre = []
        for n in prefixes:
            stop = np.minimum(start + n, end)
            pre.append(mix((run[stop] - run[start]) * down[start] + U(n)))
        return owner, whole, pre


def ngrams(texts: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte n-grams inside each text, and the text of each."""
    buf = np.frombuffer(b"".join(texts), np.uint8).astype(U) + U(1)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    hashes, owners = [], []
    for n in sizes:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, U)
        for j in range(n):
            h = h * U(_BASE) + buf[j : j + m]
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        hashes.append(salted(h[inside], n))
        owners.append(owner[:m][inside])
    if not hashes:
        return np.zeros(0, U), np.zeros(0, int)
    return np.concatenate(hashes), np.concatenate(owners)
