"""Pieces stay in the limit, overlap and lose nothing."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.chunking import Limits, pieces, split_oversized, valley_depths, _terms
from tidemark.llm.sentences import spans


def text_of(n, rng):
    out = []
    while sum(len(s.split()) for s in out) < n:
        out.append(" ".join(rng.choice(["cat", "dog", "sun", "rain"]) for _ in range(rng.randrange(3, 40))).capitalize() + ".")
    return " ".join(out)


@pytest.mark.parametrize("seed", range(8))
def test_words(seed):
    rng = random.Random(seed)
    text = text_of(rng.randrange(276, 1500), rng)
    got, cut = pieces(text, False, Limits())
    assert cut == "sentence" and len(got) > 1
    assert all(len(text[p.start : p.end].split()) == p.size <= 275 for p in got)
    assert " ".join(text[p.core : p.end] for p in got).split() == text.split()
    for a, b in zip(got, got[1:]):
        head = text[b.start : b.core].split()
        assert head == text[a.start : a.end].split()[-20:] and text[a.end - 1] == "."


def test_characters_and_inside():
    text = "很" * 2000 + "。" + "好。" * 10
    got, cut = pieces(text, True, Limits())
    assert cut == "inside" and all(p.size <= 700 for p in got)
    assert "".join(text[p.core : p.end] for p in got) == text
    assert all(b.core - b.start == 50 for b in got[1:])


def test_a_sentence_that_fits_only_without_the_overlap_is_cut_inside():
    said = lambda n: " ".join(["word"] * (n - 1)).capitalize() + " end."
    text = " ".join([said(150), said(265), said(100)])
    got, cut = pieces(text, False, Limits())
    assert cut == "sentence"  # no sentence is over the limit
    assert [p.cut for p in got] == ["sentence", "inside", "sentence"] and all(p.size <= 275 for p in got)
    assert " ".join(text[p.core : p.end] for p in got).split() == text.split()
    commas = "Word " + " ".join(["word"] * 228 + ["word,"] + ["word"] * 70) + "."
    assert commas[pieces(commas, False, Limits())[0][0].end - 1] == ","


def brute_cut(sizes, depths, at, room, least):
    """The end of the deepest valley whose piece has least to room units; ties: the last."""
    best, total, out = None, 0, None
    for i, n in enumerate(sizes[at:], at):
        total += n
        if total > room:
            break
        if total >= least and i < len(depths) and (best is None or depths[i] >= best):
            best, out = depths[i], i
    return out


@pytest.mark.parametrize("seed", range(5))
def test_first_cut_is_the_deepest_valley(seed):
    rng = random.Random(seed)
    text = text_of(1200, rng)
    sents = [text[s:e] for s, e in spans(text)]
    depths = valley_depths([_terms(s, False) for s in sents], 3)
    k = brute_cut([len(s.split()) for s in sents], depths, 0, 275, 137.5)
    assert pieces(text, False, Limits())[0][0].end == sum(len(s) + 1 for s in sents[: k + 1]) - 1


def test_exactly_the_limit():
    assert pieces("w " * 275, False, Limits()) == ([], "")
    assert pieces("字" * 700, True, Limits()) == ([], "")
    assert len(pieces("w " * 276, False, Limits())[0]) == 2
    assert pieces(None, False, Limits()) == ([], "") and pieces("", True, Limits()) == ([], "")


def test_cut_falls_into_the_valley():
    a, b = "Cats chase small mice in barns. " * 30, "Markets raised interest rates again today. " * 30
    depths = valley_depths([_terms(s, False) for s in (a + b).replace(". ", ".|").strip("|").split("|")], 3)
    assert max(range(len(depths)), key=lambda i: depths[i]) == 29
    got, _ = pieces((a + b) * 2, False, Limits())
    assert (a + b)[got[0].end - 6 : got[0].end] == "barns."


def test_table(spark):
    long = "Word. " * 300
    rows = [(1, 0, long, "en", 5), (1, 0, long, "en", 5), (1, 1, "字" * 701, " JA ", 5), (1, 2, "字" * 701, None, 5), (1, 3, None, "en", 5), (1, 4, "short", "en", 5)]
    df = spark.createDataFrame(rows, "ep bigint, idx int, body string, lang string, piece_no int")
    got = split_oversized(df, "body", F.col("lang"), ["ep", "idx"]).distinct()
    assert {(r["idx"], r["piece_no"], r["cut"], r["text_cut"]) for r in got.collect()} == {
        (0, 0, "sentence", "sentence"), (0, 1, "sentence", "sentence"), (1, 0, "inside", "inside"), (1, 1, "sentence", "inside")
    }
    assert split_oversized(df.limit(0), "body", F.col("lang"), ["ep", "idx"]).count() == 0
