"""Shares, caps and repeatability of mixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def test_rates_meet_the_shares_at_the_largest_size():
    got = M.rates({"a": 1000, "b": 100, "x": 50}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4)}, None)
    assert got["b"] == 2.0 and got["a"] * 1000 / (got["b"] * 100) == pytest.approx(5 / 3)
    assert set(got) == {"a", "b"}


def test_rates_fill_up_what_capped_sources_lack():
    got = M.rates({"a": 1000, "b": 10}, {"a": (0.5, 3), "b": (0.5, 2)}, 1000)
    assert got == {"b": 2.0, "a": pytest.approx(0.98)}
    got = M.rates({"a": 10, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, 10**9)
    assert got == {"a": 1.0, "b": 2.0}
    assert M.rates({}, {"a": (1.0, 1)}, None) == {} and M.rates({"a": 5}, {"a": (0.0, 1), "b": (None, 2)}, None) == {}


def test_mixture(spark):
    docs = [(i, f"some words number {i} " * (1 + i % 5), [" Asr-Dump", "ASR_DUMP", "asr_dump"][i % 3]) for i in range(600)]
    docs += [(1000 + i, "tiny source text here", "notes") for i in range(30)] + [(2000, None, "notes"), (2001, "", "notes"), (2002, "x", None), (2003, "other", "press kit"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit("x")).withColumn("copy_no", F.lit(1))
    t = spark.createDataFrame([("asr_dump", 0.7, 1), ("notes", 0.3, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix, report = M.mix_sources(d, t)
    rows = mix.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix_sources(d, t)[0].collect()))
    assert max(r["copy_no"] for r in rows if r["source"] == "notes") == 3 and all(r["copy_no"] == 1 for r in rows if r["source"] == "asr_dump")
    rep = {r["source"]: r for r in report.collect()}
    assert rep["asr_dump"]["actual_share"] == pytest.approx(0.7, abs=0.05) and rep["notes"]["actual_share"] == pytest.approx(0.3, abs=0.05)
    assert rep["press_kit"]["tokens_out"] == 0 and rep["absent"]["tokens_in"] == 0
    assert sum(r["n_tokens"] for r in rows) == sum(r["tokens_out"] for r in rep.values())
    empty, none = M.mix_sources(d.limit(0), t)
    assert empty.count() == 0 and none.count() == 3
    assert M.mix_sources(d, t.limit(0))[0].count() == 0


def test_token_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "你好", None, "", " <|endoftext|> "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in M.with_token_counts(df, "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
