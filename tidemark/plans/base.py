"""Typed base rows of the project's tables, and the same as SQL.

Rows that repeat a key are identical and count once; times are integer milliseconds; rows without two
finite times in order are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.islands import merge_segments
from tidemark.operators.periods import to_ms
from tidemark.plans.registry import table
from tidemark.session import cut_lineage


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarization segments (ep, idx, s, e, speaker); repeated rows are left in, for operators that count them once."""
    rows = table(spark, sf_dir, "diar_segments").where("length(trim(speaker)) > 0")
    return rows.select("ep", "idx", to_ms(F.col("start_s")).alias("s"), to_ms(F.col("end_s")).alias("e"), "speaker").where("s >= 0 AND e > s")


def merged_segments(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Merged segments; with `once` they are written to the checkpoint folder, for plans that read them more than once."""
    merged = merge_segments(segments(spark, sf_dir))
    return cut_lineage(merged) if once else merged


def roster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of an episode by rank (ep, rank, name): its roster in the order of the labels, then of the names."""
    refs = table(spark, sf_dir, "speaker_refs").select("ep", "speaker", "diar_label").distinct()
    w = Window.partitionBy("ep").orderBy("diar_label", "speaker")
    return refs.select("ep", (F.row_number().over(w) - 1).alias("rank"), F.col("speaker").alias("name"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASR phrases (ep, idx, s, e, text)."""
    rows = table(spark, sf_dir, "phrases")
    return rows.select("ep", "idx", to_ms(F.col("start_s")).alias("s"), to_ms(F.col("end_s")).alias("e"), "text").where("s >= 0 AND e >= s").distinct()


def spoken_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases (ep, idx, s, e, text, words) with their words as structs (word, ws, we) with times in order."""
    rows = table(spark, sf_dir, "phrases")
    said = F.transform("words", lambda w: F.struct(w["text"].alias("word"), to_ms(w["start_s"]).alias("ws"), to_ms(w["end_s"]).alias("we")))
    cols = ("ep", "idx", to_ms(F.col("start_s")).alias("s"), to_ms(F.col("end_s")).alias("e"), "text", F.filter(said, lambda w: (w["ws"] >= 0) & (w["we"] >= w["ws"])).alias("words"))
    return rows.select(*cols).where("s >= 0 AND e >= s").dropDuplicates(["ep", "idx"])


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated units (ep, idx, s, e, speaker, source_text, target_text)."""
    rows = table(spark, sf_dir, "translation_units")
    cols = ("ep", "idx", to_ms(F.col("start_s")).alias("s"), to_ms(F.col("end_s")).alias("e"), "speaker", "source_text", "target_text")
    return rows.select(*cols).where("s >= 0 AND e >= s").distinct()


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned words of the phrases (ep, idx, word_no, ws, we, word)."""
    rows = table(spark, sf_dir, "phrases").select("ep", "idx", "words").distinct()
    out = rows.select("ep", "idx", F.posexplode("words").alias("word_no", "w"))
    return out.select("ep", "idx", "word_no", to_ms(F.col("w.start_s")).alias("ws"), to_ms(F.col("w.end_s")).alias("we"), F.col("w.text").alias("word")).where("ws >= 0 AND we >= ws")


_MS = "CAST(round({0} * 1000) AS BIGINT)"
_TIMES = f"{_MS.format('start_s')} AS s, {_MS.format('end_s')} AS e"

SEG = f"""seg AS (SELECT * FROM (SELECT DISTINCT ep, idx, {_TIMES}, speaker FROM diar_segments
  WHERE isfinite(start_s) AND isfinite(end_s) AND length(trim(speaker)) > 0) WHERE s >= 0 AND e > s)"""
PHR = f"""phr AS (SELECT * FROM (SELECT DISTINCT ep, idx, {_TIMES}, text FROM phrases
  WHERE isfinite(start_s) AND isfinite(end_s)) WHERE s >= 0 AND e >= s)"""
UNI = f"""uni AS (SELECT * FROM (SELECT DISTINCT ep, idx, {_TIMES}, speaker, source_text, target_text FROM translation_units
  WHERE isfinite(start_s) AND isfinite(end_s)) WHERE s >= 0 AND e >= s)"""
WRD = f"""wrd AS (SELECT ep, idx, word_no - 1 AS word_no, {_MS.format('w.start_s')} AS ws, {_MS.format('w.end_s')} AS we, w.text AS word
  FROM (SELECT ep, idx, unnest(words) AS w, generate_subscripts(words, 1) AS word_no
        FROM (SELECT DISTINCT ep, idx, words FROM phrases WHERE words IS NOT NULL)))"""
MERGED = """run AS (SELECT *, sum(o) OVER (PARTITION BY ep ORDER BY s, e, idx) AS r FROM (
    SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY ep ORDER BY s, e, idx) THEN 0 ELSE 1 END AS o FROM seg)),
part AS (SELECT *, sum(c) OVER (PARTITION BY ep, r ORDER BY s, e, idx) AS p FROM (
    SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY ep, r ORDER BY s, e, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 300 THEN 0 ELSE 1 END AS c FROM run)),
merged AS (SELECT ep, min(s) AS s, max(e) AS e, min(speaker) AS speaker, count(*) AS n_rows, arg_min(idx, (s, e, idx)) AS idx FROM part GROUP BY ep, r, p)"""
RANKS = """tot AS (SELECT ep, speaker, CAST(sum(e - s) AS BIGINT) AS total_ms FROM merged GROUP BY ep, speaker),
ranks AS (SELECT ep, speaker, total_ms, row_number() OVER (PARTITION BY ep ORDER BY total_ms DESC, speaker) - 1 AS rank
  FROM (SELECT *, sum(total_ms) OVER (PARTITION BY ep) AS al FROM tot) WHERE total_ms >= 0.01 * al OR al = 0)"""
NAMED = """names AS (SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY diar_label NULLS FIRST, speaker NULLS FIRST) - 1 AS rank, speaker AS name FROM (SELECT DISTINCT ep, speaker, diar_label FROM speaker_refs)),
named AS (SELECT k.ep, k.speaker, k.total_ms, k.rank, coalesce(n.name, 'spk_' || k.rank) AS name FROM ranks k LEFT JOIN names n ON n.ep = k.ep AND n.rank = k.rank),
kept AS (SELECT m.ep, m.s, m.e, m.idx, d.name AS speaker FROM merged m JOIN named d ON d.ep = m.ep AND d.speaker = m.speaker)"""
#: Unicode white space in RE2, which knows only the ASCII kind.
NONBLANK = r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def n_words(column: str) -> str:
    return f"coalesce(len(regexp_extract_all({column}, '{NONBLANK}')), 0)"
