"""The models of the pairs, counted over all rows of labelled tables.

Each task counts the sentences it reads in Python, one shuffle adds the counts, and only what the models keep
reaches the driver: its size follows the different strings and words of the languages, not the rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lexicon as L
from tidemark.llm.langid import plains, romanise, slices
from tidemark.llm.pairs import FIT_BYTES, LEAST_CLOSINGS, LEAST_WORDS, UNMARKED, Dictionaries, closing_counts, ends_dense, words
from tidemark.llm.ppm import ByteModels, count_strings
from tidemark.llm.sentences import spans
from tidemark.session import cut_lineage

#: Entries that a task holds before it hands them on, and characters of the texts it counts at once; both only bound its memory.
MOST_ENTRIES, SLICE_CHARS = 500_000, 2_000_000
#: Kinds of counts: byte strings (in code), words, contexts (n seen, m of them at an end), windows of languages without
#: end marks, all words (m bytes of text), and sentences (m characters).
GRAM, WORD, CONTEXT, WINDOW, ALL_WORDS, SENTENCES = range(6)
_COLUMNS = ["kind", "lang", "key", "code", "n", "m"]


def labelled(langs: DataFrame, texts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(lang, text) of all rows of `texts`, (table with ep, text column, column of `langs` that names its language)."""
    found = None
    for df, column, role in texts:
        known = langs.select("ep", F.col(role).alias("lang"))
        part = df.where(F.length(column) > 0).select("ep", F.col(column).alias("text")).join(known, "ep").where(F.col("lang").isin(*L.LANGUAGE_NAMES)).select("lang", "text")
        found = part if found is None else found.unionByName(part)
    return found


def windows(texts: list[str]) -> Iterator[str]:
    """At each place after the sixth letter of a text the last 6 to 8 letters and the next one, a line feed at the end."""
    for t in texts:
        s = "".join(t.split()) + "\n"
        for i in range(6, len(s)):
            yield s[max(0, i - 8) : i + 1]


#: Different keys and how often each was counted.
Counts = tuple[np.ndarray, np.ndarray]
NOTHING: Counts = (np.empty(0, np.uint64), np.empty(0, np.int64))
#: The word id of the place between two sentences.
BETWEEN = 0


def merged(counts: Counts, keys: np.ndarray, n: np.ndarray | None = None) -> Counts:
    """The counts with those of more keys, each once if n is not given."""
    keys, at = np.unique(np.concatenate([counts[0], keys]), return_inverse=True)
    n = np.ones(len(at) - len(counts[1]), np.int64) if n is None else n
    return keys, np.bincount(at, np.concatenate([counts[1], n]), len(keys)).astype(np.int64)


class Tally:
    """Counts of the sentences of one language; words are held by their ids, contexts of `pairs.closing_counts` as pairs
    of ids or four 16-bit letters."""

    def __init__(self, lang: str, order: int):
        self.lang, self.order = lang, order
        self.ids: defaultdict[str, int] = defaultdict(count(BETWEEN + 1).__next__, {"\n": BETWEEN})
        self.grams = self.words = self.pairs = self.ended_pairs = self.letters = NOTHING
        self.seen, self.ended, self.windows = Counter(), Counter(), Counter()
        self.sentences = self.chars = self.bytes = 0

    def __len__(self) -> int:
        return sum(len(x[0]) for x in (self.grams, self.words, self.pairs, self.ended_pairs, self.letters)) + len(self.seen) + len(self.ended) + len(self.windows)

    def add(self, plains: list[bytes]) -> None:
        self.grams = merged(self.grams, *count_strings(plains, self.order + 1))
        texts = [t.decode() for t in plains if t]
        self.sentences += len(texts)
        self.chars += sum(map(len, texts))
        self.bytes += sum(map(len, plains))
        dense = [t for t in texts if not t.isascii() and ends_dense(t)]
        self.add_dense(dense)
        spaced = [t for t in texts if t.isascii() or not ends_dense(t)] if dense else texts
        ids = self.add_words(spaced)
        first, second = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
        key = first << np.uint64(32) | second
        self.pairs = merged(self.pairs, key[(first != BETWEEN) & (second != BETWEEN)])
        # a sentence of one word ends in a pair whose first word is BETWEEN
        self.ended_pairs = merged(self.ended_pairs, key[:-1][ids[2:] == BETWEEN])
        if self.lang in UNMARKED:
            self.windows.update(windows(texts))

    def add_words(self, texts: list[str]) -> np.ndarray:
        """Ids of all words, with BETWEEN at both ends of each text."""
        if not texts:
            return np.empty(0, np.int64)
        tokens = ["\n", *" \n ".join(texts).split(" "), "\n"]
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        self.words = merged(self.words, ids[ids != BETWEEN].astype(np.uint64))
        return ids

    def add_dense(self, texts: list[str]) -> None:
        self.add_words(texts)
        runs = "\n".join(t.replace(" ", "") for t in texts)
        if runs and max(runs) > "\uffff":
            seen, ended = closing_counts(texts)
            self.seen.update(seen)
            self.ended.update(ended)
            return
        self.ended.update(r[-4:] for r in runs.split("\n") if r)
        a = np.frombuffer(runs.encode("utf-16-le"), "<u2").astype(np.uint64)
        if len(a) < 4:
            return
        inside = np.ones(len(a) - 3, bool)
        key = np.zeros(len(a) - 3, np.uint64)
        for i in range(4):
            part = a[i : len(a) - 3 + i]
            inside &= part != ord("\n")
            key |= part << np.uint64(16 * i)
        self.letters = merged(self.letters, key[inside])

    def word_counts(self) -> Counter:
        """Dictionary entries: plain texts are letters and blanks, so the entries of a text are those of its words."""
        names, out = list(self.ids), Counter()
        for i, n in zip(self.words[0].tolist(), self.words[1].tolist(), strict=True):
            w = names[i]
            for x in (w,) if w.isascii() and w not in L.SHARED_WORDS else words(w):
                out[x] += n
        return out

    def frames(self) -> Iterator[pa.RecordBatch]:
        found, names = self.word_counts(), list(self.ids)
        yield self._frame(GRAM, None, self.grams[0].astype(np.int64), self.grams[1], 0)
        yield self._frame(ALL_WORDS, [None], 0, found.total(), self.bytes)
        yield self._frame(SENTENCES, [None], 0, self.sentences, self.chars)
        for kind, counts in ((WORD, found), (CONTEXT, self.seen), (WINDOW, self.windows)):
            yield self._frame(kind, list(counts), 0, np.fromiter(counts.values(), np.int64, len(counts)), 0)
        ids = lambda keys: zip((keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist(), strict=True)
        pairs = [f"{names[i]} {names[j]}" for i, j in ids(self.pairs[0])]
        ended = [names[j] if i == BETWEEN else f"{names[i]} {names[j]}" for i, j in ids(self.ended_pairs[0])]
        letters = self.letters[0].astype("<u8").tobytes().decode("utf-16-le")
        yield self._frame(CONTEXT, pairs, 0, self.pairs[1], 0)
        yield self._frame(CONTEXT, [letters[i : i + 4] for i in range(0, len(letters), 4)], 0, self.letters[1], 0)
        yield self._frame(CONTEXT, ended, 0, 0, self.ended_pairs[1])
        yield self._frame(CONTEXT, list(self.ended), 0, 0, np.fromiter(self.ended.values(), np.int64, len(self.ended)))

    def _frame(self, kind: int, key: list[str | None] | None, code: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int) -> pa.RecordBatch:
        size = len(code if key is None else key)
        numbers = [pa.array(np.full(size, x) if isinstance(x, int) else x, pa.int64()) for x in (code, n, m)]
        keys = pa.nulls(size, pa.string()) if key is None else pa.array(key, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int32()), pa.repeat(pa.scalar(self.lang), size), keys, *numbers], _COLUMNS)


def counted(texts: DataFrame, order: int) -> DataFrame:
    """(kind, lang, key, code, n, m) of all sentences of (lang, text), each combination once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        for pdf in slices((b.to_pandas() for b in batches), SLICE_CHARS):
            sentences: dict[str, list[str]] = {}
            for g, t in zip(pdf["lang"], pdf["text"], strict=True):
                room = sentences.setdefault(g, [])
                for s, e in spans(t):
                    room.append(t[s:e])
                    other = romanise(t[s:e], g)
                    if other:
                        room.append(other)
            for g, room in sentences.items():
                tallies.setdefault(g, Tally(g, order)).add(plains(room))
            if sum(map(len, tallies.values())) > MOST_ENTRIES:
                for t in tallies.values():
                    yield from t.frames()
                tallies = {}
        for t in tallies.values():
            yield from t.frames()

    parts = texts.mapInArrow(run, "kind int, lang string, key string, code bigint, n bigint, m bigint")
    return parts.groupBy("kind", "lang", "key", "code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def terminal(found: DataFrame) -> DataFrame:
    """(lang, context, went, same, ended) of the windows, as `pairs.terminal_contexts` counts them, seen often enough for `pairs.breaks_off`."""
    size = F.length("key") - 1
    each = found.where(F.col("kind") == WINDOW).select("lang", "key", "n", F.explode(F.sequence(F.lit(6), size)).alias("k"))
    # what stands before the last letter, its last k letters
    parts = each.select("lang", F.expr("substring(key, length(key) - k, k)").alias("context"), F.expr("right(key, 1)").alias("next"), "n")
    ways = parts.groupBy("lang", "context", "next").agg(F.sum("n").alias("n"))
    ended, went = F.when(F.col("next") == "\n", F.col("n")).otherwise(0), F.when(F.col("next") != "\n", F.col("n")).otherwise(0)
    return ways.groupBy("lang", "context").agg(F.sum(went).alias("went"), F.max(went).alias("same"), F.sum(ended).alias("ended")).where("went + ended >= 5")


def fit_models(texts: DataFrame, order: int = 4) -> tuple[Dictionaries, ByteModels]:
    """Dictionaries and byte models of all sentences of (lang, text).

    A word is known by how often it stands in FIT_BYTES of text, and escapes weigh as there: more text neither makes
    words of its names nor text with rare words strange.
    """
    found = cut_lineage(counted(texts, order))
    n, m, kind = F.col("n"), F.col("m"), F.col("kind")
    words_of, length = {}, {}
    for r in found.where(kind.isin(ALL_WORDS, SENTENCES)).collect():  # two rows for each language
        if r["kind"] == ALL_WORDS:
            words_of[r["lang"]] = {}, r["n"], LEAST_WORDS * max(1.0, r["m"] / FIT_BYTES)
        else:
            length[r["lang"]] = r["m"] / max(1, r["n"])
    least = F.lit(0.0)
    for g, (_, _, x) in words_of.items():
        least = F.when(F.col("lang") == g, x).otherwise(least)
    kept = (kind == GRAM) | (kind == WORD) & (n >= least) | (kind == CONTEXT) & (m >= LEAST_CLOSINGS) & (2 * m > n) & (n > 0)
    # in one order, whatever the order of the tasks
    rows = found.where(kept).toArrow().to_pandas().sort_values(["kind", "lang", "code", "key"], ignore_index=True)
    grams = {g: (np.empty(0, np.uint64), np.empty(0, np.int64)) for g in length}
    closings: dict[str, dict[str, float]] = {g: {} for g in length}
    for (k, g), part in rows.groupby(["kind", "lang"]):
        if k == GRAM:
            grams[g] = part["code"].to_numpy(np.uint64), part["n"].to_numpy(np.int64)
        elif k == WORD:
            words_of[g][0].update(zip(part["key"], part["n"].tolist(), strict=True))
        else:
            closings[g] = dict(zip(part["key"], (part["m"] / part["n"]).tolist(), strict=True))
    ends: dict[str, dict[str, tuple[int, int, int]]] = {g: {} for g in length if g in UNMARKED}
    for r in terminal(found).toArrow().to_pandas().itertuples(index=False):
        ends[r.lang][r.context] = (int(r.went), int(r.same), int(r.ended))
    return Dictionaries.from_counts(words_of, length, ends, closings), ByteModels.from_counts(grams, order, FIT_BYTES)
