"""Artifacts, event log, media and settings round trips; streaming; entry contract."""

import importlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.operators import checks as C
from tidemark.sources import artifacts as A
from tidemark.sources import config, media

SPEC = A.Spec("asr", StructType([StructField("id", IntegerType()), StructField("text", StringType())]))


def test_artifact_round_trip(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([(1, "é"), (2, None)], SPEC.schema)
    with pytest.raises(A.ArtifactError):
        A.read_artifact(spark, path, SPEC)
    assert A.load_cached(spark, path, SPEC, {"m": 1}) is None
    A.write_artifact(rows, path, SPEC, {"m": 1, "k": "x"})
    assert sorted(map(tuple, A.read_artifact(spark, path, SPEC).collect())) == [(1, "é"), (2, None)]
    assert A.load_cached(spark, path, SPEC, {"k": "x", "m": 1}) is not None
    assert A.load_cached(spark, path, SPEC, {"m": 2}) is None
    with pytest.raises(A.ArtifactError):
        A.read_artifact(spark, path, A.Spec("tts", SPEC.schema))
    assert A.load_cached(spark, path, A.Spec("asr", SPEC.schema, 2), {"m": 1, "k": "x"}) is None
    assert A.materialise(rows, path, SPEC, {"m": 1, "k": "x"}).count() == 2


def test_events_and_cache(spark, tmp_path):
    path = str(tmp_path / "log")
    row = spark.createDataFrame([("translate", 1.5, 0, [1], "m", [(1, "a", "b")])], "kind string, timestamp_s double, batch_index int, ids array<int>, model string, lines array<struct<id:int,source_text:string,target_text:string>>")
    A.append_events(row, path)
    A.append_events(row, path)
    assert A.read_events(spark, path).count() == 2
    (tmp_path / "log" / "bad.json").write_text("{no")
    with pytest.raises(Exception, match="malformed event in .*bad.json: .no"):
        A.read_events(spark, path).collect()
    with pytest.raises(Exception, match="faulty event"):
        A.append_events(row.withColumn("batch_index", F.lit(-1)), path)
    twice = spark.createDataFrame([("a", "v"), ("a", "w")], "key string, value string")
    with pytest.raises(Exception, match="holds twice: a"):
        A.unique_cache(twice).collect()
    keys, cache = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", "v")], "key string, value string")
    hit, todo = A.cached_or_todo(keys, cache)
    assert [r["value"] for r in hit.collect()] == ["v"] and [r["key"] for r in todo.collect()] == ["b"]


def test_event_faults(spark):
    line = "array<struct<id:int,source_text:string,target_text:string>>"
    rows = [
        (0, "translate", 1.0, 0, [1, 2], "m", [(1, "a", "b"), (2, "a", "b")]), (1, "translate", 0.0, -1, [1, 1], "", [(1, "a", "b"), (1, "a", "b")]),
        (2, "translate", 1.0, 0, [1, 2], "m", [(2, "a", "b"), (1, "a", None)]), (3, "other", 1.0, 0, None, "m", None), (4, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"i int, kind string, timestamp_s double, batch_index int, ids array<int>, model string, lines {line}")
    got = {r["i"]: r["f"] for r in df.select("i", A.event_faults(df).alias("f")).collect()}
    assert got == {0: [], 1: ["timestamp_s", "model", "batch_index", "ids"], 2: ["lines", "line"], 3: ["kind"], 4: ["kind", "timestamp_s", "model"]}
    told = "i int, kind string, timestamp_s double, model string, turn string, speaker string, before string, after string, budget_words int, words_before int, words_after int, duration_before_s double, duration_after_s double, window_s double, ratio double, attempt int"
    good = ("rewrite_tighter", 1.0, "m", "1", "host", "a", "b", 3, 4, 3, 2.0, 1.5, 1.6, 0.8, 0)
    df = spark.createDataFrame([(0, *good), (1, *good[:7], 0, *good[8:])], told)
    assert [r["f"] for r in df.select(A.event_faults(df).alias("f")).collect()] == [[], ["budget_words"]]


def test_batches(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = lambda *r: spark.createDataFrame(r, "batch_index int, id int, text string")
    wanted = rows((0, 1, "a"), (0, 2, "b"), (1, 3, "c"))
    assert A.batches_todo(wanted, spark, path).count() == 3
    A.write_batches(rows((0, 1, "x"), (0, 2, "y")), path)
    A.write_batches(rows((0, 1, "x"), (0, 2, "z")), path)
    assert [r["id"] for r in A.batches_todo(wanted, spark, path).collect()] == [3]
    done = spark.read.parquet(path)
    assert sorted(r["text"] for r in A.merged_batches(done, wanted.where("id < 3")).collect()) == ["x", "z"]
    with pytest.raises(Exception, match="missing: 3"):
        A.merged_batches(done, wanted).collect()
    with pytest.raises(Exception, match="in two batches: 1"):
        A.merged_batches(done.select("batch_index", "id", "text").unionByName(rows((9, 1, "q"))), wanted.where("id < 3")).collect()


def test_documents(spark, tmp_path):
    spec, rows = A.Spec("asr", SPEC.schema), [{"id": 1, "text": "é"}]
    A.write_document(tmp_path / "d" / "a.json", spec, {"b": 1, "a": 2}, rows)
    text = (tmp_path / "d" / "a.json").read_text()
    assert text.endswith("}\n") and text.index('"a": 2') < text.index('"b": 1') and "é" in text and not list((tmp_path / "d").glob("*.tmp"))
    assert A.read_document(tmp_path / "d" / "a.json", spec) == ({"a": 2, "b": 1}, rows)
    for bad in (tmp_path / "none.json", tmp_path / "broken.json"):
        (tmp_path / "broken.json").write_text("{")
        with pytest.raises(A.ArtifactError):
            A.read_document(bad, spec)
    with pytest.raises(A.ArtifactError):
        A.read_document(tmp_path / "d" / "a.json", A.Spec("tts", SPEC.schema))
    with pytest.raises(A.ArtifactError):
        A.write_document(tmp_path / "x.json", spec, {}, [{"id": 1}])
    assert {s.stage for s in A.stage_specs().values()} == {"asr", "diarize", "refs", "translate", "tts", "place"} and len(A.stage_specs()) == 7


def test_wav(spark, tmp_path):
    v = np.sin(np.arange(1000) / 7).astype(np.float32)
    (tmp_path / "x.wav").write_bytes(media.encode_wav(v, 8000))
    rate, got = media.decode_wav((tmp_path / "x.wav").read_bytes())
    assert rate == 8000 and np.abs(got - v).max() < 1e-4
    frames = media.read_wavs(spark, str(tmp_path)).collect()
    assert len(frames) == 5 and sum(len(r["samples"]) for r in frames) == 1000
    assert [(r["rate"], r["duration_s"]) for r in media.wav_durations(spark, str(tmp_path)).collect()] == [(8000, 0.125)]
    assert len(media.resample(v, 8000, 16000)) == 2000 and np.abs(media.resample(v, 8000, 16000)[::2] - v).max() < 1e-6
    tracks = spark.createDataFrame([("a", v.tolist()), ("b", [])], "name string, samples array<float>")
    done = media.write_wavs(tracks, str(tmp_path / "out"), 8000).collect()
    assert np.abs(media.decode_wav((tmp_path / "out" / "a.wav").read_bytes())[1] - v).max() < 1e-4 and not list((tmp_path / "out").glob("*.tmp"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "out"))
    expected = spark.createDataFrame([("file:" + r["path"], "0" * 64 if r["name"] == "b" else r["sha256"]) for r in done], "path string, sha256 string")
    assert [r["path"][-5:] for r in C.digest_mismatches(files, expected).collect()] == ["b.wav"]


def test_srt_and_listing(spark, tmp_path):
    cues = spark.createDataFrame([(1, 0, 1500, "Hi", 0, 0), (1, 2000, 3000, "You", 1, 0)], "ep bigint, s bigint, e bigint, text string, turn_id int, part_index int")
    blocks = [r["block"] for r in media.srt_rows(cues).orderBy("seq").collect()]
    assert blocks[0] == "1\n00:00:00,000 --> 00:00:01,500\nHi\n\n"
    media.write_srt(media.srt_rows(cues), str(tmp_path / "srt"))
    assert "00:00:02,000 --> 00:00:03,000" in next((tmp_path / "srt" / "ep=1").glob("*.txt")).read_text()
    media.write_transcripts(spark.createDataFrame([(1, "host", "甲。乙")], "ep bigint, speaker string, transcript string"), str(tmp_path / "tr"))
    assert next((tmp_path / "tr" / "ep=1" / "speaker=host").glob("*.txt")).read_text() == "甲。乙\n"
    names = spark.createDataFrame([("input.mp4",), ("input.mp4.part",), ("input.TMP",), ("x.mp4",)], "name string")
    assert [r["name"] for r in media.complete_inputs(names).collect()] == ["input.mp4"]
    held = names.withColumn("folder", F.lit("w"))
    assert media.one_input(held, "folder").count() == 1
    with pytest.raises(Exception, match="several inputs in w"):
        media.one_input(held.unionByName(held), "folder").collect()
    media.write_report(spark.createDataFrame([(1, 1, "<tr>b</tr>"), (1, 0, "<tr>a</tr>")], "ep bigint, idx int, html string"), str(tmp_path / "html"))
    page = next((tmp_path / "html" / "ep=1").glob("*.txt")).read_text().split("\n")
    assert page[0].startswith("<!doctype") and page[1:4] == ["<tr>a</tr>", "<tr>b</tr>", "</table>"]


def test_settings(tmp_path):
    f = tmp_path / "job.toml"
    f.write_text('from = "en"\nto = "de"\n')
    got = config.load_settings(f, frozenset(["source_lang", "target_lang"]))
    assert config.first_given({"target_lang": None}, got, {"target_lang": "fr", "x": 1}) == {"source_lang": "en", "target_lang": "de", "x": 1}
    with pytest.raises(ValueError):
        config.load_settings(f, frozenset(["source_lang"]))
    assert config.name_list(" a, ,b") == ["a", "b"]
    env = {"TIDEMARK_TRANSLATE_MODEL": "m2", "TIDEMARK_TRANSLATE_API_KEY": "k2"}
    assert config.resolve_api({"base_url": "u", "model": "m1", "api_key": "k1"}, env) == {"base_url": "u", "model": "m2", "api_key": "k1"}
    assert config.resolve_api({}, env)["api_key"] == "k2"
    job = config.Job("/v/talk.mkv", "en", "de")
    assert (job.output_path, job.work_path, job.audio_path) == ("/v/talk_de.mp4", "/v/talk_dubwork", "/v/talk_dubwork/talk.wav")
    assert config.Job("talk.mkv", "en", "de", "o.mp4", "w").output_path == "o.mp4" and config.Job("talk.mkv", "en", "de", "", "w").audio_path == "w/talk.wav"
    with pytest.raises(ValueError):
        config.Job("x", "en", "en")
    seen = []
    stages = {"asr": lambda j: seen.append("asr"), "tts": lambda j: seen.append("tts")}
    assert list(config.run_stages("tts, asr", stages, job)) == ["tts", "asr"] == seen
    with pytest.raises(ValueError, match="b, c"):
        config.chosen_stages("asr,b,c", stages)


def test_streaming_turns(spark, tmp_path):
    from tidemark.streaming.sessions import session_turns, windowed_activity

    t0 = datetime(2025, 1, 1)
    rows = [(1, t0, 0.0, 1.0, "a"), (1, t0, 1.5, 2.0, "a"), (1, t0, 2.5, 3.0, "b"), (1, t0, 9.0, 9.5, "b"), (2, t0 + timedelta(minutes=1), 0.0, 1.0, "a")]
    spark.createDataFrame(rows, "ep bigint, at timestamp, start_s double, end_s double, speaker string").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema("ep bigint, at timestamp, start_s double, end_s double, speaker string").parquet(str(tmp_path / "in"))
    q = session_turns(src()).writeStream.format("memory").queryName("turns_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("turns_out").collect()}
    assert {(1, "a", 0.0, 2.0, 2), (1, "b", 2.5, 3.0, 1)} <= got
    # pauses count from the last row's end, as in the batch form
    rows = [(3, t0, 0.0, 20.0, "a"), (3, t0, 1.0, 2.0, "a"), (3, t0, 5.0, 6.0, "a"), (3, t0, 30.0, 31.0, "b")]
    spark.createDataFrame(rows, "ep bigint, at timestamp, start_s double, end_s double, speaker string").coalesce(1).write.parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema("ep bigint, at timestamp, start_s double, end_s double, speaker string").parquet(str(tmp_path / "in2"))
    q = session_turns(stream).writeStream.format("memory").queryName("turns_two").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(3, "a", 0.0, 20.0, 2), (3, "a", 5.0, 6.0, 1)} <= {tuple(r) for r in spark.table("turns_two").collect()}
    q = windowed_activity(src(), "at", "speaker").writeStream.format("memory").queryName("act_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("act_out").collect()) == 5


def test_entry_and_queries(spark, sf):
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "p5_found" in e.queries()
    assert e.queries()["p5_found"](spark, sf).count() > 0


def test_core_queries_match_their_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from tidemark import plans

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    queries, sql = plans.load()
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for name, text in sql.items():
        df = queries[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted((tuple(plain(r[x]) for x in cols) for r in df.collect()), key=str)
        r = c.execute(text)
        have = [d[0] for d in r.description]
        assert sorted(have) == cols, name
        want = sorted((tuple(plain(dict(zip(have, row))[x]) for x in cols) for row in r.fetchall()), key=str)
        assert got == want, name


def test_queries_without_sql(spark, sf):
    """What the queries that SQL can't say, and the chunks, must keep of their input."""
    from tidemark import plans
    from tidemark.operators import signal as G
    from tidemark.plans import base as B

    queries, sql = plans.load()
    assert set(queries) - set(sql) == {"fit_vectors", "pipeline_fit"}
    units, chunks, report = B.units(spark, sf).collect(), queries["turn_chunks"](spark, sf).collect(), queries["turn_report"](spark, sf).collect()
    said = lambda rows, text: {ep: " ".join(t for r in sorted((r for r in rows if r["ep"] == ep), key=lambda r: tuple(r[k] for k in ("idx", "turn_id", "part_index") if k in r)) if (t := r[text])).split() for ep in {r["ep"] for r in rows}}
    want = said(units, "target_text")
    assert said(chunks, "text") == want and said(report, "text") == want and len(chunks) >= len(report) > 0
    assert sum(r["n_words"] for r in chunks) == sum(map(len, want.values())) and all(r["e"] > r["s"] for r in chunks)
    assert {(r["ep"], r["turn_id"]): r["n_parts"] for r in report} == {k: sum((c["ep"], c["turn_id"]) == k for c in chunks) for k in {(c["ep"], c["turn_id"]) for c in chunks}}
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    for r in queries["fit_vectors"](spark, sf).collect():
        fitted, notes = G.fit_samples(np.asarray(vectors[r["vec_id"]], np.float32), 0.05, 400)
        assert (r["n"], r["notes"]) == (len(fitted), notes)
    fitted = queries["pipeline_fit"](spark, sf).collect()
    assert {r["direction"] for r in fitted} <= {None, "tighter", "fuller"} and len(fitted) == len({(r["ep"], r["idx"]) for r in fitted}) > 0


def test_queries_with_sql_have_rows(spark, sf):
    """An empty table proves nothing."""
    from tidemark import plans

    queries, sql = plans.load()
    assert [n for n in sql if queries[n](spark, sf.replace("sf0.001", "sf0.01")).isEmpty()] == []


def test_pipeline_converges(spark, sf):
    from tidemark.operators.scans import require_fit
    from tidemark.plans.pipeline import fit_loop

    # 40 words need 16 s of a window of 6 s
    df = spark.createDataFrame([(1, 0, 0, 0, 6000, 40), (1, 1, 0, 6250, 9000, 5)], "ep bigint, turn_id int, part_index int, s bigint, e bigint, n_words int")
    before, after = fit_loop(df, 0)[1], fit_loop(df, 3)[1]
    assert before.where("direction = 'tighter'").count() == 1 and after.where("direction = 'tighter'").count() == 0
    require_fit(after, "tts")
    with pytest.raises(RuntimeError, match="turn 0"):
        require_fit(before, "tts")


def test_spread_and_small(spark):
    from tidemark.session import small, spread

    one = spark.range(100).coalesce(1)
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(16)
    assert spread(many, "id") is many
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(many.join(small(one), "id")) and "broadcast" not in plan(many.join(small(one, 500), "id"))


def test_checkpoint_setting(spark):
    from tidemark.session import checkpoint_dir

    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    assert spark.range(3).select(F.sum("id")).first()[0] == 3
