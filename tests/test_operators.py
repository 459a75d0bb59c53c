"""Islands, labels, signals, checks and functions on literal fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import checks as C
from tidemark.operators import islands as I
from tidemark.operators import labelling as LB
from tidemark.operators import scans as S
from tidemark.operators import signal as G

SEG = "ep bigint, idx int, s bigint, e bigint, speaker string"


@pytest.mark.parametrize("stretch", [600_000, 1500, 200])
def test_merge_segments_against_a_loop(spark, stretch):
    rng = np.random.default_rng(3)
    rows = []
    for ep in range(20):
        for i in range(60):
            s = int(rng.integers(0, 20000))
            rows.append((ep, i, s, s + int(rng.integers(1, 900) * (20 if i % 17 == 0 else 1)), str(rng.choice(["a", "b", "b", "b"]))))
    want = set()
    for ep in range(20):
        out = []
        for _, i, s, e, sp in sorted((r for r in rows if r[0] == ep), key=lambda r: (r[2], r[3], r[1])):
            if out and out[-1][2] == sp and s - out[-1][1] < 300:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e, sp])
        want |= {(ep, *x) for x in out}
    got = {(r["ep"], r["s"], r["e"], r["speaker"]) for r in I.merge_segments(spark.createDataFrame(rows, SEG), stretch_ms=stretch).collect()}
    assert got == want


def test_turn_gap_uses_the_last_unit(spark):
    rows = [(1, 0, 0, 20000, "h"), (1, 1, 1000, 2000, "h"), (1, 2, 4500, 5000, "h"), (1, 3, 7600, 8000, "h")]
    got = [r["turn_id"] for r in I.coalesce_turns(spark.createDataFrame(rows, SEG)).orderBy("idx").collect()]
    assert got == [0, 0, 0, 1]


def test_collapsed_runs(spark):
    rows = [(1, 0, i, 5, 5) for i in range(9)] + [(1, 1, i, 5, 5) for i in range(8)]
    df = spark.createDataFrame(rows, "ep bigint, phrase int, word_no int, s bigint, e bigint")
    assert [tuple(r) for r in I.collapsed_runs(df).collect()] == [(1, 0, 5, 9)]


def test_ranks_break_ties_by_label(spark):
    rows = [(1, 0, 0, 1000, "b"), (1, 1, 2000, 3000, "a"), (1, 2, 4000, 4010, "noise")]
    got = LB.speaker_ranks(spark.createDataFrame(rows, SEG)).orderBy("rank").collect()
    assert [(r["speaker"], r["rank"]) for r in got] == [("a", 0), ("b", 1)]


PHR = "ep bigint, idx int, s bigint, e bigint, text string"
WRD = "ep bigint, idx int, word_no int, ws bigint, we bigint, word string"
NAMES = [(1, 0, "host"), (1, 1, "guest")]


def labelled(spark, segs, phrases, words=(), names=NAMES):
    """Rows (idx, s, e, speaker, text, words) of label_pieces, and the same after the orphans are merged."""
    merged = I.merge_segments(spark.createDataFrame([(1, i, *r) for i, r in enumerate(segs)], SEG))
    named = LB.named_speakers(LB.speaker_ranks(merged), spark.createDataFrame(names, "ep bigint, rank int, name string"))
    said = [(1, i, *p, [(w[4], w[2], w[3]) for w in words if w[0] == i] or None) for i, p in enumerate(phrases)]
    rows = spark.createDataFrame(said, PHR + ", words array<struct<word:string,ws:bigint,we:bigint>>")
    pieces = LB.label_pieces(rows, LB.kept_segments(merged, named), named)
    told = lambda df: [(r["s"], r["e"], r["speaker"], r["text"], len(r["words"] or [])) for r in df.orderBy("ep", "idx", "bucket").collect()]
    return told(pieces), told(S.merge_orphans(pieces))


def test_handoff_splits_words(spark):
    words = [(0, 0, 1000, 1400, "你"), (0, 1, 1500, 1900, "好"), (0, 2, 5300, 5700, "大"), (0, 3, 5800, 6200, "家")]
    got, _ = labelled(spark, [(0, 5000, "s0"), (5100, 9000, "s1")], [(1000, 8000, "你好大家")], words)
    assert got == [(1000, 1900, "host", "你好", 2), (5300, 6200, "guest", "大家", 2)]


def test_short_flip_is_no_handoff(spark):
    words = [(0, i, 1000 * t, 1000 * t + 400, c) for i, (t, c) in enumerate(zip((1, 2, 4, 5), "abcd"))]
    got, _ = labelled(spark, [(0, 3000, "s0"), (3000, 3200, "s1"), (3200, 12000, "s0"), (20000, 30000, "s1")], [(1000, 5400, "abcd")], words)
    assert got == [(1000, 5400, "host", "abcd", 4)]


def test_noise_speakers_are_left_out(spark):
    segs = [(0, 10000, "s0"), (10000, 10050, "s2"), (10050, 20000, "s1")]
    got, _ = labelled(spark, segs, [(9900, 10200, "x y")], names=[])
    assert got == [(9900, 10200, "spk_1", "x y", 0)]  # s2 would hold most of it but has under 1 % of the time
    # the dropped speaker is no handoff either: s0 and s1 are next to each other
    words = [(0, 0, 9000, 9400, "a"), (0, 1, 10600, 11000, "b")]
    got, _ = labelled(spark, segs, [(9000, 11000, "ab")], words)
    assert [(r[2], r[3]) for r in got] == [("host", "a"), ("guest", "b")]


def test_phrase_without_words_stays_whole(spark):
    got, _ = labelled(spark, [(0, 5000, "s0"), (5100, 8000, "s1")], [(1000, 8000, "one two")])
    assert got == [(1000, 8000, "host", "one two", 0)]


def test_first_wins_and_fallbacks(spark):
    got, _ = labelled(spark, [(0, 1000, "a"), (1000, 2000, "b")], [(500, 1500, "x"), (1200, 1900, "y"), (5000, 6000, "z"), (500, 500, "w")])
    assert [r[2] for r in got] == ["host", "guest", "host", "host"]
    got, _ = labelled(spark, [], [(0, 5, "x")])
    assert got == [(0, 5, "spk_0", "x", 0)]


def test_orphans_join_with_their_words(spark):
    words = [(0, 0, 10000, 12000, "是更重要"), (1, 0, 12300, 12300, "的")]
    _, got = labelled(spark, [(0, 20000, "s0"), (21000, 40000, "s1")], [(10000, 12000, "是更重要"), (12300, 12300, "的")], words)
    assert got == [(10000, 12300, "host", "是更重要的", 2)]


@pytest.mark.parametrize("block", [600_000, 2500, 10])
def test_blocks_equal_whole_windows(spark, block):
    rng = np.random.default_rng(1)
    rows = [(ep, i, int(rng.integers(0, 20000)), int(rng.integers(0, 9))) for ep in (0, 1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "ep bigint, idx int, s bigint, x int")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    pairs = list(zip(order, [*order[1:], None]))
    for ahead in (True, False):
        got = {(r["ep"], r["idx"]): r["nx"] for r in I.neighbour(df, ["s", "idx"], {"nx": "x"}, block, ahead).collect()}
        want = {a[:2]: b[3] if b and a[0] == b[0] else None for a, b in (pairs if ahead else [(b, a) for a, b in zip([None, *order], order)])}
        assert got == want
    sums, most = {}, {}
    for ep in (0, 1, 2, None):
        total, top = 0, -1
        for r in (r for r in order if r[0] == ep):
            total, top = total + r[3], max(top, r[3])
            sums[r[:2]], most[r[:2]] = total, top
    assert {(r["ep"], r["idx"]): r["t"] for r in I.running(df, ["s", "idx"], {"t": F.col("x")}, block).collect()} == sums
    assert {(r["ep"], r["idx"]): r["t"] for r in I.running(df, ["s", "idx"], {"t": F.col("x")}, block, most=True).collect()} == most


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_context_over_blocks(spark, block):
    rows = [(1, i * 3, None if i == 4 else str(i)) for i in range(20)]
    got = [r["context"] for r in I.preceding_context(spark.createDataFrame(rows, "ep bigint, idx int, text string"), "text", block=block).orderBy("idx").collect()]
    assert got == [" ".join(str(k) for k in range(max(0, i - 3), i) if k != 4) for i in range(20)]


def test_clean_segments_and_top_up(spark):
    segs = spark.createDataFrame([(1, 0, 0, 5000, "h"), (1, 1, 6000, 14000, "h"), (1, 2, 5100, 5200, "g"), (1, 3, 20000, 90000, "g")], SEG)
    clean = LB.clean_segments(segs)
    assert [r["idx"] for r in clean.collect()] == [1]
    assert [r["idx"] for r in LB.top_up(clean, 1).collect()] == [1]
    assert LB.top_up(clean, least_ms=8000).count() == 1
    with pytest.raises(Exception, match="8000 ms of clean speech of h"):
        LB.top_up(clean, least_ms=8001).collect()


def test_max_plus_starts(spark):
    rng = np.random.default_rng(5)
    rows, cue = [], 0
    for i in range(300):
        cue += int(rng.integers(200, 3000))
        rows.append((1, i, cue, int(rng.integers(100, 3000))))
    got = [r["start"] for r in I.max_plus_starts(spark.createDataFrame(rows, "ep bigint, idx int, cue bigint, dur bigint")).orderBy("idx").collect()]
    want, end = [], None
    for _, _, c, d in rows:
        s = c if end is None else max(end + 250, c - 1500)
        want.append(s)
        end = s + d
    assert got == want


def test_gate(spark):
    masks = spark.createDataFrame([("x", i, 1, int(i == 0)) for i in range(4)] + [("y", 0, 0, 1), ("y", 1, 0, None), ("z", 0, 1, 1)], "k string, frame int, original int, dub int")
    got = {r["k"]: r for r in G.gate_passes(G.coverage_gate(masks, ["k"], "frame", 0), 1.0, most_s=1.0).collect()}
    assert {k: (r["coverage"], r["longest_dead"], r["passes"]) for k, r in got.items()} == {"x": (0.25, 3, False), "y": (0.0, 0, False), "z": (1.0, 0, True)}


@pytest.mark.parametrize("seed", range(3))
def test_gate_against_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    o, d = rng.integers(0, 2, 200), (rng.random(200) < 0.2).astype(int)
    rows = [(1, i, int(a), int(b)) for i, (a, b) in enumerate(zip(o, d))]
    near = [max(d[max(0, i - 2) : i + 3]) for i in range(200)]
    longest = run = 0
    for a, b in zip(o, near):
        run = run + 1 if a and not b else 0
        longest = max(longest, run)
    r = G.coverage_gate(spark.createDataFrame(rows, "k int, frame int, original int, dub int"), ["k"], "frame", 2).first()
    assert r["longest_dead"] == longest and r["coverage"] == pytest.approx(sum(a and b for a, b in zip(o, near)) / o.sum())


def rebuilt(audio, pauses, lengths, fade):
    """The vector piece by piece."""
    ramp, out, at = np.linspace(0, 1, fade), [], 0
    for (a, b), n in [*zip(pauses, lengths), ((len(audio), None), None)]:
        piece = audio[at:a].astype(float)
        m = min(fade, len(piece) // 2)
        for i in range(m):
            piece[i] *= ramp[i]
            if n is not None:
                piece[len(piece) - 1 - i] *= ramp[i]
        out.append(piece)
        if n is not None:
            out.append(np.zeros(n))
            at = b
    return np.concatenate(out)


@pytest.mark.parametrize("seed", range(6))
def test_pauses_are_set(seed):
    rng = np.random.default_rng(seed)
    audio = rng.random(500).astype(np.float32)
    at = np.sort(rng.choice(500, 6, replace=False)).tolist()
    pauses = [(at[0], at[1]), (at[2], at[3]), (at[4], at[5])][: rng.integers(0, 4)]
    if seed == 5:
        pauses = [(0, 20), (480, 500)]
    lengths = rng.integers(0, 60, len(pauses)).tolist()
    assert np.allclose(G.with_pauses(audio, pauses, lengths, 8), rebuilt(audio, pauses, lengths, 8), atol=1e-6)


def test_fit_plan_is_the_policy():
    plan = lambda d, p, w: (lambda x: (x[0].tolist(), round(x[1], 4)))(G.fit_plan(d, np.array(p, float), w, 1000))
    assert plan(10_000, [500, 100], 9_700) == ([120, 100], 1.0)
    assert plan(10_000, [500, 100], 9_000) == ([120, 100], round(9620 / 9000, 4))
    assert plan(10_000, [], 5_000) == ([], 1.12)
    assert plan(10_000, [500], 10_000) == ([500], 1.0)
    assert plan(8_000, [500], 8_400) == ([900], 1.0) and plan(8_000, [50], 9_000) == ([50], 1.0)
    assert plan(8_000, [1000, 2000], 30_000) == ([1500, 1500], 1.0)


def test_misfit(spark):
    rows = spark.createDataFrame([(12.1, 10.0), (12.0, 10.0), (8.9, 10.0), (9.5, 10.0), (1.0, 0.0)], "d double, w double")
    assert [r["x"] for r in rows.select(G.needs_rewrite(F.col("d"), F.col("w")).alias("x")).collect()] == [True, False, True, False, None]


def test_trimmed_samples(spark):
    df = spark.createDataFrame([(0, 90, [0.0] * 20), (1, 0, [0.0] * 20), (2, 150, [0.0] * 20)], "i int, off int, v array<float>")
    assert [r["trimmed"] for r in G.trimmed(df, "off", "v", 100).orderBy("i").collect()] == [10, 0, 20]


def test_silence_and_fit():
    rate = 8000
    speech = (0.5 * np.sin(np.arange(rate * 4))).astype(np.float32)
    audio = np.concatenate([speech, np.zeros(rate * 2, np.float32), speech])
    frame = rate // 40
    assert G.silence_intervals(audio, rate) == [(len(speech) // frame * frame, len(speech) // frame * frame + 2 * rate)]
    fitted, notes = G.fit_samples(audio, 7.0, rate)
    assert notes == ["pause-compress -1.9s", "fast 1.12"] and abs(len(fitted) / rate - 8.12 / 1.12) < 0.05
    fitted, notes = G.fit_samples(audio, 11.0, rate)
    assert notes == ["pause-compress -0.5s"] and abs(len(fitted) / rate - 9.5) < 0.05  # the cap on a pause also shortens it
    short = np.concatenate([speech, np.zeros(rate // 2, np.float32), speech])
    fitted, notes = G.fit_samples(short, 8.8, rate)
    assert notes == ["pause-stretch +0.3s"] and abs(len(fitted) / rate - 8.8) < 0.05
    assert G.silence_intervals(np.zeros(10, np.float32), rate) == []


def test_text_functions(spark):
    one = spark.range(1)
    row = one.select(
        T.srt_time(F.lit(3661507)).alias("a"),
        T.srt_time(F.lit(60000)).alias("b"),
        T.word_count(F.lit(" one two　three ")).alias("c"),
        T.word_count(F.lit(None).cast("string")).alias("d"),
        T.word_budget(F.lit(1.0)).alias("e"),
        T.word_budget(F.lit(0.0)).alias("f"),
        T.fit_reward(F.lit(20), F.lit(19)).alias("g"),
        T.fit_reward(F.lit(0), F.lit(19)).alias("h"),
        T.tempo_chain(F.lit(5.0)).alias("i"),
        T.interpolated_budget(F.lit(10), F.lit(12), F.lit(0.01)).alias("j"),
        T.html_escape(F.lit("<a & 'b'>")).alias("k"),
        T.round3(F.lit(0.0005)).alias("l"),
        T.ends_sentence(F.lit("Yes.”")).alias("m"),
    ).first()
    assert tuple(row) == ("01:01:01,507", "00:01:00,000", 3, 0, 2, 1, 0.5, 0.0, "atempo=2.0,atempo=2.0,atempo=1.25000", 11, "&lt;a &amp; &#x27;b&#x27;&gt;", 0.0, True)


def test_checks(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, -1.0, -2.0)], "id int, start_s double, end_s double")
    got = {r["id"]: r["v"] for r in rows.select("id", C.span_violations(rows).alias("v")).collect()}
    assert got == {1: [], 2: ["missing"], 3: ["not_finite"], 4: ["negative", "order"]}
    js = spark.createDataFrame([(1, '{"a": [{"auto_map": {"auto_map": 1}}]}'), (2, "no json"), (3, None), (4, "{}")], "id int, body string")
    assert {tuple(r) for r in C.unsafe_fields(js, "body", ["id"]).collect()} == {(1, "a[0].auto_map"), (2, "!")}
    assert C.UNSAFE_KEYS == ("_attn_implementation_internal", "_experts_implementation_internal", "auto_map", "trust_remote_code")
    assert [r["id"] for r in C.missing_keys(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,)], "id int"), ["id"]).collect()] == [1]


def test_pcm(spark):
    mix = spark.createDataFrame([("a", 0, 1.78), ("a", 1, -0.5), ("b", 0, 0.5)], "k string, pos int, value double")
    got = {(r["k"], r["pos"]): r["pcm"] for r in G.normalise(mix, ["k"]).collect()}
    assert got == {("a", 0): int(0.89 * 32767), ("a", 1): int(-0.25 * 32767), ("b", 0): 16383}


@pytest.mark.parametrize("margin", [0, 250])
def test_interval_join_equals_a_plain_one(spark, margin, monkeypatch):
    from tidemark.operators import intervals
    from tidemark.operators.intervals import overlap_join

    monkeypatch.setattr(intervals, "WIDER", 2)  # spans of both widths

    rng = np.random.default_rng(9)
    span = lambda n: [(int(rng.integers(0, 3)), i, s := int(rng.integers(0, 5000)), s + int(rng.integers(0, 2500))) for i in range(n)]
    a, b = span(80), span(80)
    left = spark.createDataFrame(a, "ep bigint, i int, s bigint, e bigint")
    right = spark.createDataFrame(b, "ep bigint, j int, rs bigint, re bigint")
    on = (F.col("rs") < F.col("e") + margin) & (F.col("re") > F.col("s") - margin)
    got = sorted((r["i"], r["j"]) for r in overlap_join(left, right, "ep", ("s", "e"), ("rs", "re"), on, width=700, margin=margin).collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] < x[3] + margin and y[3] > x[2] - margin)
    assert got == want


def test_an_absurd_span_costs_few_buckets(spark):
    from tidemark.operators import intervals

    df = spark.createDataFrame([(1, 0, 10**12), (2, 5, 70_000), (3, None, 4), (4, 0, 1 << 53)], "ep bigint, s bigint, e bigint")
    n = {r["ep"]: r["count"] for r in intervals._bucketed(df, "s", "e", 60_000, 0, 0, 1).groupBy("ep").count().collect()}
    assert n[1] < 200 and n[2] == 3 and 3 not in n and n[4] < 1_200_000
    found = intervals.overlap_join(df, df.select("ep", F.col("s").alias("a"), F.col("e").alias("b")), "ep", ("s", "e"), ("a", "b"), F.lit(True))
    assert sorted(r["ep"] for r in found.collect()) == [1, 2, 4]


def test_logical_turns(spark):
    rows = [(1, 0, 7, "a", 0, 9), (1, 1, 7, "a", 10, 12), (1, 2, 8, "b", 13, 14), (1, 3, 8, "c", 15, 20), (1, 4, 7, "a", 21, 22)]
    turns = I.logical_turns(spark.createDataFrame(rows, "ep bigint, idx int, turn_id int, speaker string, s bigint, e bigint"), ["idx"])
    got = [(r["turn_id"], r["s"], r["e"], r["n_chunks"], r["reappears"], r["mixed"]) for r in turns.orderBy("run").collect()]
    assert got == [(7, 0, 12, 2, False, False), (8, 13, 20, 2, False, True), (7, 21, 22, 1, True, False)]
    with pytest.raises(RuntimeError, match="turn 8 contains multiple speakers"):
        I.require_logical(turns, "tts")
    I.require_logical(turns.where("run = 0"), "tts")


def test_strict_zip_and_reports(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "ep bigint, idx int, l string")
    b = spark.createDataFrame([(1, 0, "p"), (1, 1, "q")], "ep bigint, idx int, r string")
    assert {(r["l"], r["r"]) for r in C.strict_zip(a, b, ["ep"], "idx").collect()} == {("x", "p"), ("y", "q")}
    with pytest.raises(Exception, match="one side lacks position 1 of 1"):
        C.strict_zip(a, b.where("idx = 0"), ["ep"], "idx").collect()
    want = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 5)], "ep bigint, id int")
    got = C.missing_report(want, spark.createDataFrame([(1, 3)], "ep bigint, id int"), "ep", "id", 4).orderBy("ep").collect()
    assert [tuple(r) for r in got] == [(1, 24, [0, 1, 2, 4]), (2, 1, [5])]
    texts = spark.createDataFrame([(0, "ab", None), (1, " a ", "abc")], "i int, s string, t string")
    assert [r["b"] for r in texts.select(C.blank_texts(texts, ["s", "t"], 2).alias("b")).collect()] == [["t"], ["s"]]


def test_settings_folders(spark, tmp_path):
    with pytest.raises(RuntimeError, match="no config.json"):
        C.require_safe_settings(spark, str(tmp_path))
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "config.json").write_text('{"x": [{"y": 1}]}')
    (tmp_path / "a" / "b" / "config.json").write_text("{}")
    assert C.require_safe_settings(spark, str(tmp_path)) == 2
    (tmp_path / "a" / "b" / "config.json").write_text('{"x": [{"trust_remote_code": false}]}')
    with pytest.raises(RuntimeError, match=r"x\[0\].trust_remote_code in .*b/config.json"):
        C.require_safe_settings(spark, str(tmp_path))
    (tmp_path / "a" / "b" / "config.json").write_text("{")
    with pytest.raises(RuntimeError, match="is no JSON"):
        C.require_safe_settings(spark, str(tmp_path))
