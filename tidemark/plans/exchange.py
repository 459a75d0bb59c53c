"""Round trips through the sources, sinks and streams, in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import round3
from tidemark.plans import base as B
from tidemark.plans.registry import query, table
from tidemark.session import checkpoint_dir
from tidemark.sources import artifacts as A
from tidemark.sources import media
from tidemark.streaming.sessions import session_turns


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT DISTINCT start_s AS "start", end_s AS "end", speaker FROM diar_segments WHERE length(trim(speaker)) > 0 AND isfinite(start_s) AND isfinite(end_s)""")
def artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as an artifact with its envelope, found again by their provenance, and read."""
    big = F.lit(float("inf"))
    rows = table(spark, sf_dir, "diar_segments").where("length(trim(speaker)) > 0").where(~F.isnan("start_s") & ~F.isnan("end_s") & (F.abs("start_s") < big) & (F.abs("end_s") < big))
    rows = rows.select(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "speaker").distinct()
    path, spec = _folder(spark, "artifact"), A.stage_specs()["diarization_segments"]
    made = A.materialise(rows, path, spec, {"table": "diar_segments"})
    again = A.load_cached(spark, path, spec, {"table": "diar_segments"})
    return made if again is None else again


_GOOD = """good AS (SELECT DISTINCT ep, idx, kind, timestamp_s, batch_index, line_ids, model_id, pairs FROM translate_events WHERE kind = 'translate' AND timestamp_s > 0 AND length(model_id) > 0 AND batch_index >= 0
  AND len(list_distinct(line_ids)) = len(line_ids) AND list_transform(pairs, lambda x: x.id) = line_ids
  AND len(list_filter(pairs, lambda x: NOT coalesce(length(x.source_text) > 0 AND length(x.target_text) > 0 AND x.id >= 0, false))) = 0)"""


@query(f"WITH {_GOOD} SELECT batch_index, model_id AS model, count(*) AS n_events, CAST(sum(len(pairs)) AS BIGINT) AS n_lines, CAST(sum(list_sum(list_transform(pairs, lambda x: length(x.target_text)))) AS BIGINT) AS n_chars FROM good GROUP BY batch_index, model_id")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faultless events of the log, appended as JSON lines and read again under the log's schema."""
    ev = table(spark, sf_dir, "translate_events").where("kind = 'translate'")
    ev = ev.select("ep", "idx", "kind", "timestamp_s", "batch_index", F.col("line_ids").alias("ids"), F.col("model_id").alias("model"), F.col("pairs").alias("lines")).distinct()
    path = _folder(spark, "events")
    A.append_events(ev.where(F.size(A.event_faults(ev)) == 0).drop("ep", "idx"), path)
    chars = F.aggregate("lines", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["target_text"]))
    return A.read_events(spark, path).groupBy("batch_index", "model").agg(F.count("*").alias("n_events"), F.sum(F.size("lines")).alias("n_lines"), F.sum(chars).alias("n_chars"))


@query("""SELECT 'v' || vec_id AS name, 400 AS rate, CAST((len(embedding) + 9) // 10 AS BIGINT) AS n_frames, CAST(len(embedding) AS BIGINT) AS n_samples FROM embeddings""")
def wav_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as WAV files and read again in frames of 25 ms."""
    path = _folder(spark, "wav").removeprefix("file://").removeprefix("file:")
    tracks = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("name"), F.col("embedding").cast("array<float>").alias("samples"))
    media.write_wavs(tracks, path, 400).write.mode("overwrite").parquet(f"{path}-written")
    frames = media.read_wavs(spark, path)
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    return frames.groupBy(name.alias("name"), "rate").agg(F.count("*").alias("n_frames"), F.sum(F.size("samples")).cast("bigint").alias("n_samples"))


@query(f"""WITH {B.UNI}, t AS (SELECT ep, speaker, string_agg(target_text, '。' ORDER BY idx) AS transcript FROM (SELECT ep, speaker, idx, regexp_replace(target_text, '[\\r\\n]+', ' ', 'g') AS target_text FROM uni WHERE length(target_text) > 0 AND speaker IS NOT NULL) GROUP BY ep, speaker)
SELECT ep, speaker, transcript FROM t""")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript a speaker, written as text files by episode and speaker and read again."""
    said = B.units(spark, sf_dir).where("length(target_text) > 0 AND speaker IS NOT NULL").withColumn("t", F.regexp_replace("target_text", r"[\r\n]+", " "))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"])
    path = _folder(spark, "transcripts")
    media.write_transcripts(said.groupBy("ep", "speaker").agg(F.concat_ws("。", parts).alias("transcript")), path)
    return spark.read.text(path).select(F.col("ep").cast("bigint").alias("ep"), F.col("speaker").cast("string").alias("speaker"), F.col("value").alias("transcript"))


_STREAMED = """u AS (SELECT DISTINCT ep, idx, start_s, end_s, speaker FROM translation_units WHERE isfinite(start_s) AND isfinite(end_s) AND speaker IS NOT NULL),
o AS (SELECT *, lag(speaker) OVER w AS sp, lag(end_s) OVER w AS pe FROM u WINDOW w AS (PARTITION BY ep ORDER BY start_s, end_s, idx)),
n AS (SELECT *, sum(CASE WHEN sp = speaker AND start_s - pe <= 2.5 THEN 0 ELSE 1 END) OVER (PARTITION BY ep ORDER BY start_s, end_s, idx) AS turn FROM o),
t AS (SELECT ep, turn, min(speaker) AS speaker, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_rows FROM n GROUP BY ep, turn)"""


@query(f"WITH {_STREAMED} SELECT ep, speaker, start_s, end_s, n_rows FROM (SELECT *, max(turn) OVER (PARTITION BY ep) AS last FROM t) WHERE turn < last")
def streamed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a stream of units; the last turn of an episode is still open when the stream has read all."""
    path = _folder(spark, "stream")
    big = F.lit(float("inf"))
    rows = table(spark, sf_dir, "translation_units").where("speaker IS NOT NULL").where((F.abs("start_s") < big) & (F.abs("end_s") < big))
    rows = rows.select("ep", "idx", F.lit("2025-01-01 00:00:00").cast("timestamp").alias("at"), "start_s", "end_s", "speaker").distinct()
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    run = session_turns(stream, order="idx").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("ep bigint, speaker string, start_s double, end_s double, n_rows bigint").parquet(f"{path}/out")


@query("""SELECT DISTINCT ep, idx, CAST(printf('%.3f', start_s) AS DOUBLE) AS start_s FROM translation_units WHERE isfinite(start_s)""")
def rounded_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "translation_units").where(~F.isnan("start_s") & (F.abs("start_s") < F.lit(float("inf"))))
    return rows.select("ep", "idx", round3(F.col("start_s")).alias("start_s")).distinct()


@query("""WITH j AS (SELECT ep, any_value(video) AS video, any_value(lower(trim(target_lang))) AS lang FROM jobs GROUP BY ep),
s AS (SELECT *, regexp_replace(regexp_extract(video, '[^/]+$'), '\\.[^.]*$', '') AS stem FROM j)
SELECT ep, regexp_replace(video, '\\.[^./]*$', '') || '_' || lang || '.mp4' AS output, stem || '_dubwork' AS workdir, stem || '.wav' AS audio FROM s""")
def derived_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that follow from a job's video: the output, the work folder and the sound file in it."""
    jobs = table(spark, sf_dir, "jobs").groupBy("ep").agg(F.first("video").alias("video"), F.first(F.lower(F.trim("target_lang"))).alias("lang"))
    stem = F.regexp_replace(F.regexp_extract("video", "[^/]+$", 0), r"\.[^.]*$", "")
    out = F.concat(F.regexp_replace("video", r"\.[^./]*$", ""), F.lit("_"), "lang", F.lit(".mp4"))
    return jobs.select("ep", out.alias("output"), F.concat(stem, F.lit("_dubwork")).alias("workdir"), F.concat(stem, F.lit(".wav")).alias("audio"))
