"""Evaluation passages inside a training corpus, by spaced-seed hashing.

Texts are compared as streams of letters and digits (NFKC, lower case). A fixed mask picks some of the
positions of a window and ignores the others, so a seed survives a substitution at an ignored place.
All windows of the test items are hashed, and every `stride`-th window of a document; a common stretch of
L characters holds at least floor((L - span + 1) / stride) sampled windows, so with a stride of at most
L - span + 1 no stretch is missed. A stretch with k substitutions holds an exact run of at least
(L - k) / (k + 1) characters: span and stride follow from the run that the shortest stretch leaves
(`Rule.seed`), so no stretch with the allowed substitutions is missed either, up to `MOST_SUBSTITUTIONS`. Hits are grouped by
document, item and diagonal, and the overlap along each diagonal is then verified: the longest exact run, and
the longest run with a few substitutions.

Test items are broadcast only below a checked size of their index; beyond it hashes are joined in Spark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.langid import slices
from tidemark.session import share, shared

# --- fixed values: seed masks (1: compared, 0: ignored)
MASKS = ("110111011011110110111011", "101101111101101111011011")
SPAN = 24
#: Beyond it the exact runs of a stretch are too short for seeds.
MOST_SUBSTITUTIONS = 4
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


@dataclass(frozen=True)
class Rule:
    """How long a stretch must be, by the language of the item."""

    least: int = 80
    least_dense: int = 40
    dense_langs: tuple[str, ...] = ("ja", "ko", "zh")
    substitutions: int = 0
    shown_substitutions: int = 2
    broadcast_bytes: int = 32 << 20
    slice_chars: int = 1_000_000

    def __post_init__(self) -> None:
        if not 0 <= self.substitutions <= MOST_SUBSTITUTIONS:
            raise ValueError(f"substitutions must be from 0 to {MOST_SUBSTITUTIONS}")

    @property
    def seed(self) -> tuple[int, int]:
        """(span of the masks, stride of the windows of a document)."""
        run = (min(self.least, self.least_dense) - self.substitutions) // (self.substitutions + 1)
        span = min(SPAN, run) if self.substitutions == 0 else min(SPAN, max(7, run - 3), run)
        return span, min(16, run - span + 1)

    def needed(self, least: int) -> int:
        """Sampled windows on one diagonal that a stretch of `least` characters can't do without."""
        span, stride = self.seed
        return max(1, (least - span + 1) // stride) if self.substitutions == 0 else 1


def stream(text: str | None) -> str:
    """The letters and digits of a text after NFKC and lower-casing."""
    if not text:
        return ""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


@lru_cache(maxsize=64)
def _factors(mask: int, span: int) -> list[tuple[int, np.uint64]]:
    """(position, factor) of the compared positions of a mask; short masks end like the long ones, compared."""
    rng = np.random.default_rng(20240229)
    mult = rng.integers(1, 1 << 63, SPAN, dtype=np.uint64) | np.uint64(1)
    return [(i, mult[i]) for i, c in enumerate(MASKS[mask][:span]) if c == "1" or i == span - 1]


def seed_hashes(codes: np.ndarray, at: np.ndarray, mask: int, span: int = SPAN) -> np.ndarray:
    """Hash of the masked window at each position."""
    h = np.zeros(len(at), np.uint64)
    for i, f in _factors(mask, span):
        h += codes[at + i].astype(np.uint64) * f
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def longest_run(eq: np.ndarray, substitutions: int) -> int:
    """Longest stretch of `eq` with at most that many False."""
    z = np.concatenate([[-1], np.nonzero(~eq)[0], [len(eq)]])
    k = substitutions + 1
    if len(z) <= k:
        return len(eq)
    return int((z[k:] - z[:-k] - 1).max())


@dataclass
class ItemIndex:
    """Hashes of all windows of the items, sorted, for each mask."""

    ids: list
    streams: list[np.ndarray]
    least: np.ndarray
    hashes: list[np.ndarray]
    owner: list[np.ndarray]
    place: list[np.ndarray]


def index_items(ids: list, texts: list, langs: list, rule: Rule) -> ItemIndex:
    streams = [_codes(stream(t)) for t in texts]
    least = np.array([rule.least_dense if (g or "").strip().lower() in rule.dense_langs else rule.least for g in langs], np.int64)
    hs, os, ps = [], [], []
    span = rule.seed[0]
    for m in range(len(MASKS)):
        h, o, p = [], [], []
        for k, c in enumerate(streams):
            if len(c) >= least[k]:
                at = np.arange(len(c) - span + 1)
                h.append(seed_hashes(c, at, m, span))
                o.append(np.full(len(at), k, np.int64))
                p.append(at)
        h, o, p = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((h, np.uint64), (o, np.int64), (p, np.int64)))
        order = np.argsort(h, kind="stable")
        hs.append(h[order])
        os.append(o[order])
        ps.append(p[order])
    return ItemIndex(ids, streams, least, hs, os, ps)


def _document_seeds(texts: list, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All streams in one array; its row starts; and row and offset of each sampled window."""
    streams = [stream(t) for t in texts]
    lens = np.array([len(s) for s in streams], np.int64)
    codes = _codes("".join(streams))
    starts = np.concatenate([[0], np.cumsum(lens)])
    span, stride = rule.seed
    n = np.maximum(0, (lens - span) // stride + 1) * (lens >= span)
    row = np.repeat(np.arange(len(lens)), n)
    off = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
    return codes, starts, row, off


def find_in_batch(texts: list, idx: ItemIndex, rule: Rule) -> list[tuple[int, int, int, int]]:
    """(row, item, exact run, run with substitutions) of the verified overlaps of a batch."""
    codes, starts, row, off = _document_seeds(texts, rule)
    if not len(row) or not len(idx.streams):
        return []
    at = starts[row] + off
    keys = []
    for m in range(len(MASKS)):
        if not len(idx.hashes[m]):
            continue
        h = seed_hashes(codes, at, m, rule.seed[0])
        lo = np.searchsorted(idx.hashes[m], h, "left")
        hit = np.nonzero((lo < len(idx.hashes[m])) & (idx.hashes[m][np.minimum(lo, len(idx.hashes[m]) - 1)] == h))[0]
        if not len(hit):
            continue
        lo = lo[hit]
        n = np.searchsorted(idx.hashes[m], h[hit], "right") - lo
        src = np.repeat(hit, n)
        pos = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys.append(np.stack([row[src], idx.owner[m][pos], off[src] - idx.place[m][pos], off[src]], 1))
    if not keys:
        return []
    hits = np.unique(np.concatenate(keys), axis=0)
    diag, count = np.unique(hits[:, :3], axis=0, return_counts=True)
    needed = np.array([rule.needed(int(v)) for v in idx.least])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for r, k, d in diag[count >= needed[diag[:, 1]]]:
        doc, item = codes[starts[r] : starts[r + 1]], idx.streams[k]
        a, b = max(0, d), min(len(doc), len(item) + d)
        eq = doc[a:b] == item[a - d : b - d]
        run, near = longest_run(eq, 0), longest_run(eq, rule.shown_substitutions)
        if longest_run(eq, rule.substitutions) >= idx.least[k]:
            old = best.get((r, k), (0, 0))
            best[r, k] = (max(run, old[0]), max(near, old[1]))
    return [(int(r), int(k), run, near) for (r, k), (run, near) in best.items()]


def find_leaks(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Pairs (doc_id, item_id, run, near_run) of documents that hold a long enough stretch of an item.

    `docs` has doc_id and text, `items` item_id, text and lang. `run` is the longest exact stretch,
    `near_run` the longest with `shown_substitutions` characters replaced. Null or short texts on either
    side give no pair; repeated rows of a document give one pair; without items there are no rows.
    """
    items = items.select("item_id", "text", "lang").where("text is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()["chars"]
    # an index entry takes 24 bytes for each mask and window; normalisation may lengthen a text, so the index counts
    if chars * 24 * len(MASKS) <= rule.broadcast_bytes:
        rows = items.collect()  # bounded by rule.broadcast_bytes
        index = index_items([r["item_id"] for r in rows], [r["text"] for r in rows], [r["lang"] for r in rows], rule)
        if sum(map(len, index.hashes)) * 24 <= rule.broadcast_bytes:
            return _by_broadcast(docs, items, index, rule)
    return _by_join(docs, items, rule)


def _types(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _by_broadcast(docs: DataFrame, items: DataFrame, index: ItemIndex, rule: Rule) -> DataFrame:
    given = share(docs.sparkSession, index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx = shared(given)
        for pdf in slices(batches, rule.slice_chars):
            found = find_in_batch(list(pdf["text"]), idx, rule)
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].iloc[[f[0] for f in found]].to_numpy(),
                    "item_id": [idx.ids[f[1]] for f in found],
                    "run": pd.array([f[2] for f in found], "int32"),
                    "near_run": pd.array([f[3] for f in found], "int32"),
                }
            )

    schema = f"doc_id {_types(docs, 'doc_id')}, item_id {_types(items, 'item_id')}, run int, near_run int"
    found = docs.select("doc_id", "text").where(F.length("text") > 0).mapInPandas(run, schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("near_run").alias("near_run"))


def _by_join(docs: DataFrame, items: DataFrame, rule: Rule) -> DataFrame:
    """The same result by a join of hashes, for test sets of any size."""
    doc_type, item_type = _types(docs, "doc_id"), _types(items, "item_id")

    def doc_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, rule.slice_chars):
            codes, starts, row, off = _document_seeds(list(pdf["text"]), rule)
            for m in range(len(MASKS)):
                h = seed_hashes(codes, starts[row] + off, m, rule.seed[0]) if len(row) else np.empty(0, np.uint64)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[row].to_numpy(), "mask": np.full(len(row), m, np.int32), "h": h.view(np.int64), "off": off.astype(np.int64)})

    def item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            idx = index_items(list(pdf["item_id"]), list(pdf["text"]), list(pdf["lang"]), rule)
            for m in range(len(MASKS)):
                o = idx.owner[m]
                need = np.array([rule.needed(int(v)) for v in idx.least], np.int32)
                yield pd.DataFrame({"item_id": pdf["item_id"].iloc[o].to_numpy(), "mask": np.full(len(o), m, np.int32), "h": idx.hashes[m].view(np.int64), "place": idx.place[m], "needed": need[o]})

    # repeated rows of a document give repeated candidates, which the grouping below takes together
    texts = docs.select("doc_id", "text").where(F.length("text") > 0)
    left = texts.mapInPandas(doc_seeds, f"doc_id {doc_type}, mask int, h bigint, off bigint")
    right = items.mapInPandas(item_seeds, f"item_id {item_type}, mask int, h bigint, place bigint, needed int")
    diagonals = (
        left.join(right, ["mask", "h"])
        .select("doc_id", "item_id", (F.col("off") - F.col("place")).alias("diag"), "off", "needed")
        .distinct()
        .groupBy("doc_id", "item_id", "diag")
        .agg(F.count("*").alias("hits"), F.max("needed").alias("needed"))
        .where("hits >= needed")
    )
    # the texts meet a pair once, with all its diagonals
    pairs = diagonals.groupBy("doc_id", "item_id").agg(F.collect_set("diag").alias("diags"))
    pairs = pairs.join(items.select("item_id", F.col("text").alias("item_text"), "lang"), "item_id").join(texts, "doc_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            runs, nears, ok = [], [], []
            for t, u, g, diags in zip(pdf["text"], pdf["item_text"], pdf["lang"], pdf["diags"], strict=True):
                doc, item = _codes(stream(t)), _codes(stream(u))
                least = rule.least_dense if (g or "").strip().lower() in rule.dense_langs else rule.least
                run = near = 0
                for d in diags:
                    a, b = max(0, d), min(len(doc), len(item) + d)
                    eq = doc[a:b] == item[a - d : b - d]
                    if longest_run(eq, rule.substitutions) >= least:
                        run, near = max(run, longest_run(eq, 0)), max(near, longest_run(eq, rule.shown_substitutions))
                ok.append(near > 0)
                runs.append(run)
                nears.append(near)
            out = pdf[["doc_id", "item_id"]].assign(run=np.array(runs, np.int32), near_run=np.array(nears, np.int32))
            yield out[np.array(ok, bool)]

    found = pairs.mapInPandas(verify, f"doc_id {doc_type}, item_id {item_type}, run int, near_run int")
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("near_run").alias("near_run"))
