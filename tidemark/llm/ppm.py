"""Prediction by partial matching: exact code lengths of texts under frozen per-language byte models.

Each language has a tree of byte contexts up to `order` bytes. In a context seen T times with q different
symbols, a symbol seen n times has probability n / (T + q), and q / (T + q) escapes to the next shorter
context, down to one chance in 256. The trees of all languages are merged into one table of byte strings:
an entry holds the exact code length of its last byte after its other bytes, for every language at once,
so that scoring a byte takes one look-up and, for unseen strings, one more for each escape.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Open-addressing index from uint64 keys to their positions, built and read in whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)
        self.vals = np.full(size, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.vals[s] < 0
            cand = todo[free]
            at, first = np.unique(s[free], return_index=True)
            put = cand[first]
            self.vals[at] = put
            self.keys[at] = keys[put]
            placed = np.zeros(len(keys), bool)
            placed[put] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is missing."""
        slot = self._slot(keys)
        out = self.vals[slot]
        todo = np.nonzero((out >= 0) & (self.keys[slot] != keys))[0]
        mask = len(self.vals) - 1
        while len(todo):
            s = (slot[todo] + 1) & mask
            slot[todo] = s
            v = self.vals[s]
            out[todo] = v
            todo = todo[(v >= 0) & (self.keys[s] != keys[todo])]
        return out


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k-byte string that ends at each position, as an integer; shorter heads count as zero bytes."""
    key = np.zeros(len(data), np.uint64)
    for i in range(k):
        part = data[: len(data) - i].astype(np.uint64) << np.uint64(8 * i)
        key[i:] |= part
    return key


def count_strings(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different k-byte strings that end at the bytes of the texts, as integers, and how often; each text starts after k - 1 line feeds."""
    pad = b"\n" * (k - 1)
    raw = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    scored = np.ones(len(raw), bool)
    starts = np.cumsum([0] + [len(t) + k - 1 for t in texts][:-1]) if texts else np.empty(0, np.int64)
    for i in range(k - 1):
        scored[starts.astype(np.int64) + i] = False
    return np.unique(grams(raw, k)[scored], return_counts=True)


@dataclass
class Order:
    """Entries of one context length: code lengths of strings and escapes of contexts."""

    strings: KeyTable
    bits: np.ndarray
    contexts: KeyTable
    escapes: np.ndarray


@dataclass
class ByteModels:
    """Frozen models of several languages; `order` is the longest context in bytes."""

    langs: list[str]
    order: int = 5
    levels: list[Order] = field(default_factory=list)

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], order: int = 5) -> ByteModels:
        """Models from sample texts of each language; each text starts after line feeds."""
        return cls.from_counts({g: count_strings(samples[g], order + 1) for g in samples}, order)

    @classmethod
    def from_counts(cls, counted: dict[str, tuple[np.ndarray, np.ndarray]], order: int = 5, escape_bytes: int | None = None) -> ByteModels:
        """Models from the different strings of order + 1 bytes of each language and how often each stands in its texts.

        With `escape_bytes` an escape weighs as it does in so many bytes of text; else it gets dearer the more text
        there is, and so would all text of the language that holds a rare word.
        """
        langs = sorted(counted)
        m = cls(langs, order)
        n = len(langs)
        if not n:
            return m
        below_keys, below_bits = np.zeros(0, np.uint64), np.zeros((0, n), np.float32)
        for k in range(order + 1):
            counts = []
            for g in langs:
                # a shorter string stands wherever a longer one ends in it
                full, c = counted[g]
                keys, at = np.unique(full & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
                counts.append((keys, np.bincount(at, c, len(keys))))
            keys = np.unique(np.concatenate([c[0] for c in counts]))
            ctx = np.unique(keys >> np.uint64(8))
            bits = np.zeros((len(keys), n), np.float32)
            esc = np.zeros((len(ctx), n), np.float32)
            if k:
                suffix = keys & np.uint64((1 << (8 * k)) - 1)
                lower = below_bits[np.searchsorted(below_keys, suffix)]
            else:
                lower = np.full((len(keys), n), 8.0, np.float32)
            for j, (g, (own, c)) in enumerate(zip(langs, counts, strict=True)):
                weight = max(1.0, counted[g][1].sum() / escape_bytes) if escape_bytes else 1.0
                at_ctx = np.searchsorted(ctx, own >> np.uint64(8))
                total = np.bincount(at_ctx, c, len(ctx))
                kinds = weight * np.bincount(at_ctx, minlength=len(ctx))
                seen = total > 0
                esc[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                bits[:, j] = lower[:, j] + esc[np.searchsorted(ctx, keys >> np.uint64(8)), j]
                at = np.searchsorted(keys, own)
                bits[at, j] = -np.log2(c / (total[at_ctx] + kinds[at_ctx]))
            m.levels.append(Order(KeyTable(keys), bits, KeyTable(ctx), esc))
            below_keys, below_bits = keys, bits
        return m

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language: an array (texts, languages)."""
        n = len(self.langs)
        out = np.zeros((len(texts), n))
        if not texts:
            return out
        pad = b"\n" * self.order
        data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        lens = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lens + self.order)
        inside = np.ones(len(data), bool)
        heads = ends - lens - self.order
        for i in range(self.order):
            inside[heads + i] = False
        at = np.nonzero(inside)[0]
        owner = np.repeat(np.arange(len(texts)), lens)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            key = self._keys(data, at, k + 1)
            pos = level.strings.find(key)
            hit = pos >= 0
            self._add(out, owner[hit], level.bits, pos[hit])
            miss = ~hit
            if not miss.any():
                return out
            at, owner = at[miss], owner[miss]
            pos = level.contexts.find(key[miss] >> np.uint64(8))
            hit = pos >= 0
            self._add(out, owner[hit], level.escapes, pos[hit])
        np.add(out, 8.0 * np.bincount(owner, minlength=len(texts))[:, None], out=out)
        return out

    @staticmethod
    def _keys(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        key = np.zeros(len(at), np.uint64)
        for i in range(k):
            key |= data[at - i].astype(np.uint64) << np.uint64(8 * i)
        return key

    @staticmethod
    def _add(out: np.ndarray, owner: np.ndarray, table: np.ndarray, pos: np.ndarray) -> None:
        if not len(pos):
            return
        first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
        # in slices, so that the gathered rows stay small
        step = 1 << 16
        if len(pos) <= step:
            out[owner[first]] += np.add.reduceat(table[pos], first, axis=0, dtype=np.float64)
            return
        for a in range(0, len(pos), step):
            o, p = owner[a : a + step], pos[a : a + step]
            f = np.nonzero(np.concatenate([[True], o[1:] != o[:-1]]))[0]
            out[o[f]] += np.add.reduceat(table[p], f, axis=0, dtype=np.float64)
