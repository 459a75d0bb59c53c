"""Continuous periods against a plain union of intervals."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.operators import periods as P


def union(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def expected(rows):
    by = {}
    for k, sp, s, e in rows:
        if None not in (k, sp, s, e) and 0 <= s < e:
            by.setdefault((k, sp), []).append((s, e))
    out = set()
    for k, v in by.items():
        u = union(v)
        out |= {(*k, "period", a, b) for a, b in u}
        out |= {(*k, "gap", x[1], y[0]) for x, y in zip(u, u[1:])}
    return out


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1000), st.integers(1, 300)), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_reduce_is_the_union(rows):
    rows = sorted((g, s, min(1024, s + d)) for g, s, d in rows)
    g, s, e = (np.array(x, np.int64) for x in zip(*rows))
    got = list(zip(*(x.tolist() for x in P._reduce(g, s, e, 10))))
    want = [(k, *u) for k in sorted({r[0] for r in rows}) for u in union([(a, b) for i, a, b in rows if i == k])]
    assert got == want


@given(st.integers(0, 5000), st.integers(1, 5000))
@settings(max_examples=200, deadline=None)
def test_blocks_are_canonical(s, d):
    e = s + d
    code, level = P.dyadic_blocks(np.zeros(1, np.int64), np.array([s]), np.array([e]), 14)
    spans = sorted((int(c), int(c) + (1 << int(n))) for c, n in zip(code, level))
    assert spans[0][0] == s and spans[-1][1] == e
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(a % (b - a) == 0 for a, b in spans)


def test_sibling_merge_makes_parents():
    code, level = P.merge_siblings(np.array([0, 1, 2, 3, 8]), np.array([0, 0, 0, 0, 0]), 4)
    assert sorted(zip(code.tolist(), level.tolist())) == [(0, 2), (8, 0)]


@pytest.mark.parametrize("scale", [1, 997, 2_000_003])
def test_merge_intervals_over_many_cells(spark, scale):
    rng = random.Random(scale)
    rows = []
    for _ in range(400):
        s = rng.randrange(-3, 2000) * scale
        rows.append((rng.choice([1, 2, None]), rng.choice(["a", "b", None]), s, s + rng.choice([0, 1, 2, 5, -1, 40]) * scale))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "ep bigint, speaker string, start_ms bigint, end_ms bigint")
    got = {tuple(r) for r in P.merge_intervals(df, ["ep", "speaker"]).collect()}
    assert got == expected(rows)


def test_one_very_long_interval(spark):
    rows = [(1, "a", 0, 1 << 41), (1, "a", (1 << 41) + 1, (1 << 41) + 5), (1, "a", 7, 9)]
    df = spark.createDataFrame(rows, "ep bigint, speaker string, start_ms bigint, end_ms bigint")
    assert {tuple(r) for r in P.merge_intervals(df, ["ep", "speaker"]).collect()} == expected(rows)


@pytest.mark.parametrize("seed", range(3))
def test_long_and_absurd_intervals(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        s = rng.randrange(1 << rng.choice([12, 22, 32, 42, 50]))
        rows.append((rng.choice([1, 2]), "a", s, s + rng.choice([1, 3, 1 << 20, (1 << 30) + 5, (1 << 31) - 1, 1 << 41, 3 << 40][: 7 if rng.random() < 0.1 else 3])))
    rows += [(1, "a", (1 << 52) + 7, 1 << 53), (2, "a", 1 << 30, 1 << 31), (2, "a", 0, 1 << 30)]
    df = spark.createDataFrame(rows, "ep bigint, speaker string, start_ms bigint, end_ms bigint")
    assert {tuple(r) for r in P.merge_intervals(df, ["ep", "speaker"]).collect()} == expected(rows)


def test_an_absurd_row_changes_no_other_cell(spark):
    rows = [(1, "a", i * 3_000_000, i * 3_000_000 + 5) for i in range(50)]
    plain = spark.createDataFrame(rows, "ep bigint, speaker string, start_ms bigint, end_ms bigint")
    more = plain.unionByName(spark.createDataFrame([(2, "a", 0, 10**12)], plain.schema))
    seen = lambda df: P.merge_intervals(df, ["ep", "speaker"])
    assert set(map(tuple, seen(plain).collect())) < set(map(tuple, seen(more).collect()))
    assert seen(more).where("ep = 2").collect() == [(2, "a", "period", 0, 10**12)]
    parts = spark.range(1).select(F.inline(P._wide_parts(F.lit(12345), F.lit(10**12)))).collect()
    assert sum(r["b"] - r["a"] for r in parts) < 5000


def test_many_rows_of_one_cell_are_reduced(spark, monkeypatch):
    rows = [(1, "a", i % 5000, i % 5000 + 1) for i in range(0, 40000, 2)]
    df = spark.createDataFrame(rows, "ep bigint, speaker string, start_ms bigint, end_ms bigint")
    monkeypatch.setattr(P, "HELD_ROWS", 500)
    assert {tuple(r) for r in P.merge_intervals(df, ["ep", "speaker"]).collect()} == expected(rows)


def test_seconds_with_nulls_noise_and_extra_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, 0.0000001, 1.0, "a", "x"), (1, 1, 1.0000000002, 2.0, "a", "x"), (1, 2, 2.001, 3.0, "a", None), (1, 3, nan, 9.0, "a", "x"),
        (1, 4, 5.0, inf, "a", "x"), (1, 5, -1.0, 9.0, "a", "x"), (1, 6, 4.0, 4.0, "a", "x"), (1, 7, None, 4.0, "a", "x"), (1, 8, 1.0, 5.0, " ", "x"),
        (1, 9, 1.0, 5.0, None, "x"), (None, 1, 1.0, 2.0, "a", "x"), (1, 10, 1e300, 1e301, "a", "x"), (2, 11, 1.0, 1e300, "a", "x"),
    ]
    df = spark.createDataFrame(rows, "ep bigint, idx int, start_s double, end_s double, speaker string, kind string")
    got = {tuple(r) for r in P.speaking_periods(df).collect()}
    assert got == {(1, "a", "period", 0, 2000), (1, "a", "gap", 2000, 2001), (1, "a", "period", 2001, 3000), (2, "a", "period", 1000, P.LAST_MS)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "ep bigint, idx int, start_s double, end_s double, speaker string")
    assert P.speaking_periods(df).collect() == []
