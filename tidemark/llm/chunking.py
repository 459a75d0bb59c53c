"""Splitting oversized texts at natural boundaries (lexical cohesion).

Sentences are the units. Blocks of sentences left and right of each gap are compared as bags of terms
(words, or character pairs in scripts without spaces); a valley of that similarity marks a change of
topic. Each piece ends at the deepest valley of its size window, and every piece after the first begins
with the last words (or characters) of the piece before. A sentence that doesn't fit beside the overlap is
cut inside: after the last mark inside the sentence (comma, semicolon, colon, dash) of the size window, else
at a word end. The core spans of the pieces tile the text, so nothing is lost.

Null and blank texts and texts within the limit give no rows: they need no cut.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sentences import VOCABULARY, Words, load_words, spans
from tidemark.session import share, shared

#: Marks inside a sentence at which it may be cut.
_CLAUSE = regex.compile(r"[,;:，、；：،؛—–]")
_WORD = regex.compile(r"\S+")
_CHAR = regex.compile(r"\S")


@dataclass(frozen=True)
class Limits:
    """Sizes of a piece: words in spaced languages, characters without white space elsewhere."""

    words: int = 275
    overlap_words: int = 20
    chars: int = 700
    overlap_chars: int = 50
    char_langs: tuple[str, ...] = ("ja", "th", "zh")
    block: int = 3
    least_fill: float = 0.5


def _terms(text: str, by_char: bool) -> Counter:
    if by_char:
        s = "".join(text.split())
        return Counter(s[i : i + 2] for i in range(len(s) - 1)) if len(s) > 1 else Counter([s])
    return Counter(w.strip(".,;:!?\"'()«»“”").lower() for w in text.split())


def _cosine(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    dot = sum(v * b[k] for k, v in a.items() if k in b)
    if not dot:
        return 0.0
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def valley_depths(bags: list[Counter], block: int) -> list[float]:
    """Depth of the similarity valley at each gap between neighbouring sentences."""
    n = len(bags)
    sims = []
    for g in range(1, n):
        left, right = Counter(), Counter()
        for b in bags[max(0, g - block) : g]:
            left.update(b)
        for b in bags[g : g + block]:
            right.update(b)
        sims.append(_cosine(left, right))
    # the nearest peak to either side, reached without going down
    left, right = sims[:], sims[:]
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            left[i] = left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            right[i] = right[i + 1]
    return [(a - s) + (b - s) for a, b, s in zip(left, right, sims, strict=True)]


@dataclass(frozen=True)
class Piece:
    start: int  # with the overlap
    core: int
    end: int
    size: int
    overlap: int  # units that the piece before holds too
    cut: str  # where it ends: 'sentence' or 'inside' one


def pieces(text: str | None, by_char: bool, lim: Limits, words: Words | None = None) -> tuple[list[Piece], str]:
    """The pieces of a text over the limit, and 'inside' if one of its sentences is itself over the limit,
    else 'sentence'; ([], '') within it."""
    if not text:
        return [], ""
    most, overlap = (lim.chars, lim.overlap_chars) if by_char else (lim.words, lim.overlap_words)
    units = [m.span() for m in (_CHAR if by_char else _WORD).finditer(text)]
    if len(units) <= most:
        return [], ""
    sents = spans(text, words)
    # the number of units that end at or before each sentence end
    ends, k = [], 0
    for _, e in sents:
        while k < len(units) and units[k][1] <= e:
            k += 1
        ends.append(k)
    ends[-1] = len(units)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    cut = "inside" if max(sizes) > most else "sentence"
    depths = valley_depths([_terms(text[s:e], by_char) for s, e in sents], lim.block)
    out: list[Piece] = []
    at, prev_start = 0, 0
    whole = set(ends)
    while at < len(units):
        head = min(overlap, at - prev_start) if out else 0
        room = most - head
        if len(units) - at <= room:
            stop = len(units)
        else:
            fits = range(bisect_right(ends, at), bisect_right(ends, at + room))
            window = [i for i in fits if ends[i] - at >= lim.least_fill * room and i < len(depths)]
            if window:
                stop = ends[max(window, key=lambda i: (depths[i], ends[i]))]
            elif fits:
                stop = ends[fits[-1]]
            else:
                stop = _clause_end(text, units, at + max(1, math.ceil(lim.least_fill * room)), at + room)
        first = at - head
        out.append(Piece(units[first][0], units[at][0], units[stop - 1][1], stop - first, head, "sentence" if stop in whole else "inside"))
        prev_start, at = first, stop
    return out, cut


def least_length(limits: Limits = Limits()) -> int:
    """Characters below which no text can be over a limit."""
    return min(2 * limits.words + 1, limits.chars + 1)


def _clause_end(text: str, units: list[tuple[int, int]], low: int, high: int) -> int:
    """The last number of units from low to high after which a clause ends, else high."""
    for k in range(high, low - 1, -1):
        if _CLAUSE.match(text, units[k - 1][1] - 1):
            return k
    return high


def split_oversized(df: DataFrame, text: str, lang: Column, keys: list[str], limits: Limits = Limits(), vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every text over its limit.

    Columns: keys, piece_no, char_start (with overlap), core_start, char_end, size, overlap, cut (of the piece:
    'sentence' or 'inside') and text_cut ('inside' if a sentence of the text is itself over the limit). A text over
    either limit has more than 2 * words characters or more than `chars`; shorter ones are left out by a
    JVM filter before any text reaches Python. A null language counts words.
    """
    least = least_length(limits)
    base = df.select(
        *keys,
        F.col(text).alias("_text"),
        F.coalesce(F.lower(F.trim(lang)).isin(*limits.char_langs), F.lit(False)).alias("_by_char"),
    ).where(F.length("_text") >= least)
    given = share(df.sparkSession, load_words(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared(given)
        for pdf in batches:
            rows, cols = [], []
            for r, (t, by_char) in enumerate(zip(pdf["_text"], pdf["_by_char"], strict=True)):
                found, cut = pieces(t, by_char, limits, known)
                for k, p in enumerate(found):
                    rows.append(r)
                    cols.append((k, p.start, p.core, p.end, p.size, p.overlap, p.cut, cut))
            out = pdf[keys].iloc[rows].reset_index(drop=True)
            names = ["piece_no", "char_start", "core_start", "char_end", "size", "overlap", "cut", "text_cut"]
            got = pd.DataFrame(cols, columns=names)
            yield pd.concat([out, got.astype(dict.fromkeys(names[:6], "int32") | {"cut": "object", "text_cut": "object"})], axis=1)

    schema = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name[0] != "_")
    return base.mapInPandas(run, schema + ", piece_no int, char_start int, core_start int, char_end int, size int, overlap int, cut string, text_cut string")
