"""Islands, labels, references and placement on the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import word_count
from tidemark.operators import checks as C
from tidemark.operators import islands as I
from tidemark.operators import labelling as LB
from tidemark.operators import scans as S
from tidemark.plans import base as B
from tidemark.plans import sequential as Q
from tidemark.plans.registry import query, table
from tidemark.session import cut_lineage, small


@query(f"WITH {B.SEG}, {B.MERGED} SELECT ep, idx, s, e, speaker, n_rows FROM merged")
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.merged_segments(spark, sf_dir).select("ep", "idx", "s", "e", "speaker", "n_rows")


@query(f"""WITH {B.SEG}, {B.MERGED}, {B.RANKS}, {B.NAMED} SELECT ep, speaker, total_ms, CAST(rank AS INT) AS rank, name FROM named""")
def speaker_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = LB.speaker_ranks(B.merged_segments(spark, sf_dir))
    return LB.named_speakers(ranks, B.roster_names(spark, sf_dir)).select("ep", "speaker", "total_ms", "rank", "name")


def _labelled(spark: SparkSession, sf_dir: str, twice: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged segments, named speakers, named segments); the first is read from a checkpoint, with `twice` all are,
    for plans that use the segments more than once."""
    merged = B.merged_segments(spark, sf_dir, once=True)
    named = LB.named_speakers(LB.speaker_ranks(merged), B.roster_names(spark, sf_dir))
    if not twice:
        return merged, named, LB.kept_segments(merged, named)
    named = cut_lineage(named)
    return merged, named, cut_lineage(LB.kept_segments(merged, small(named)))


_BEST = """ov AS (SELECT p.ep, p.idx, m.speaker, row_number() OVER (PARTITION BY p.ep, p.idx ORDER BY least(p.e, m.e) - greatest(p.s, m.s) DESC, m.s, m.e, m.speaker) AS k
  FROM phr p JOIN kept m ON m.ep = p.ep AND m.s < p.e AND p.s < m.e AND least(p.e, m.e) > greatest(p.s, m.s)),
lab AS (SELECT p.ep, p.idx, p.s, p.e, p.text, coalesce(o.speaker, t.name, 'spk_0') AS speaker
  FROM phr p LEFT JOIN ov o ON o.ep = p.ep AND o.idx = p.idx AND o.k = 1 LEFT JOIN named t ON t.ep = p.ep AND t.rank = 0)"""


@query(f"WITH {B.SEG}, {B.MERGED}, {B.RANKS}, {B.NAMED}, {B.PHR}, {_BEST} SELECT ep, idx, s, e, speaker FROM lab")
def overlap_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, named, kept = _labelled(spark, sf_dir)
    rows = B.phrases(spark, sf_dir).drop("text")
    return LB.label_by_overlap(rows, kept, named).select("ep", "idx", "s", "e", "speaker")


_CUTS = """nx AS (SELECT *, lead(s) OVER w AS ns, lead(e) OVER w AS ne, lead(speaker) OVER w AS nsp FROM kept WINDOW w AS (PARTITION BY ep ORDER BY s, e, idx)),
cuts AS (SELECT DISTINCT p.ep, p.idx, n.e + n.ns AS cut2 FROM phr p JOIN nx n ON n.ep = p.ep AND n.nsp <> n.speaker
  AND n.e + n.ns > 2 * (p.s + 50) AND n.e + n.ns < 2 * (p.e - 50)
  AND least(n.e, p.e) - greatest(n.s, p.s) >= 400 AND least(n.ne, p.e) - greatest(n.ns, p.s) >= 400)"""
_KEPT = f"{B.SEG}, {B.MERGED}, {B.RANKS}, {B.NAMED}, {B.PHR}"


@query(f"WITH {_KEPT}, {_CUTS} SELECT ep, idx, cut2 FROM cuts")
def handoff_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.handoff_cuts(B.phrases(spark, sf_dir), _labelled(spark, sf_dir)[2])


_BUCKETS = """b AS (SELECT w.*, (SELECT count(*) FROM cuts c WHERE c.ep = w.ep AND c.idx = w.idx AND c.cut2 < w.ws + w.we)::INT AS bucket
  FROM wrd w WHERE (w.ep, w.idx) IN (SELECT (ep, idx) FROM cuts)),
bucketed AS (SELECT ep, idx, bucket, arg_min(ws, word_no) AS s, arg_max(we, word_no) AS e, count(*) AS n_words, coalesce(string_agg(word, '' ORDER BY word_no), '') AS text FROM b GROUP BY ep, idx, bucket)"""


@query(f"WITH {_KEPT}, {_CUTS}, {B.WRD}, {_BUCKETS} SELECT ep, idx, bucket, s, e, n_words, text FROM bucketed")
def word_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = LB.handoff_cuts(B.phrases(spark, sf_dir), _labelled(spark, sf_dir)[2])
    return LB.split_at_cuts(B.words(spark, sf_dir), cuts).drop("words")


_PIECES = """pieces AS (SELECT ep, idx, bucket, s, e, text, n_words FROM bucketed UNION ALL
  SELECT p.ep, p.idx, 0, p.s, p.e, p.text, (SELECT count(*) FROM wrd w WHERE w.ep = p.ep AND w.idx = p.idx) FROM phr p WHERE (p.ep, p.idx) NOT IN (SELECT (ep, idx) FROM bucketed)),
pov AS (SELECT p.ep, p.idx, p.bucket, m.speaker, row_number() OVER (PARTITION BY p.ep, p.idx, p.bucket ORDER BY least(p.e, m.e) - greatest(p.s, m.s) DESC, m.s, m.e, m.speaker) AS k
  FROM pieces p JOIN kept m ON m.ep = p.ep AND m.s < p.e AND p.s < m.e AND least(p.e, m.e) > greatest(p.s, m.s)),
plab AS (SELECT p.*, coalesce(o.speaker, t.name, 'spk_0') AS speaker FROM pieces p LEFT JOIN pov o ON o.ep = p.ep AND o.idx = p.idx AND o.bucket = p.bucket AND o.k = 1
  LEFT JOIN named t ON t.ep = p.ep AND t.rank = 0)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, named, kept = _labelled(spark, sf_dir, twice=True)
    return LB.label_pieces(B.spoken_phrases(spark, sf_dir), kept, named)


@query(f"WITH {_KEPT}, {_CUTS}, {B.WRD}, {_BUCKETS}, {_PIECES} SELECT ep, idx, CAST(bucket AS INT) AS bucket, s, e, text, CAST(n_words AS INT) AS n_words, speaker FROM plab")
def labelled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases cut at handoffs, every piece labelled by itself."""
    return _pieces(spark, sf_dir).select("ep", "idx", "bucket", "s", "e", "text", F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0)).alias("n_words"), "speaker")


_CLEAN = """clean AS (SELECT m.* FROM merged m WHERE m.e - m.s BETWEEN 4000 AND 12000 AND NOT EXISTS (
  SELECT 1 FROM merged o WHERE o.ep = m.ep AND o.speaker <> m.speaker AND o.s < m.e + 200 AND o.e > m.s - 200))"""


@query(f"WITH {B.SEG}, {B.MERGED}, {_CLEAN} SELECT ep, idx, s, e, speaker FROM clean")
def clean_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.clean_segments(B.merged_segments(spark, sf_dir, once=True)).select("ep", "idx", "s", "e", "speaker")


_TOP = """chosen AS (SELECT * FROM (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY ep, speaker ORDER BY e - s DESC, s, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
  FROM clean) WHERE had < 60000)"""


@query(f"WITH {B.SEG}, {B.MERGED}, {_CLEAN}, {_TOP} SELECT ep, idx, s, e, speaker FROM chosen")
def reference_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.top_up(LB.clean_segments(B.merged_segments(spark, sf_dir, once=True))).select("ep", "idx", "s", "e", "speaker")


@query(f"""WITH {_KEPT}, {_CLEAN}, {_TOP}, {_BEST},
sg AS (SELECT c.ep, c.speaker, c.idx, c.s, trim(string_agg(l.text, '' ORDER BY l.s, l.idx)) AS t
  FROM chosen c JOIN named d ON d.ep = c.ep AND d.speaker = c.speaker
  JOIN lab l ON l.ep = c.ep AND l.speaker = d.name AND l.text IS NOT NULL AND greatest(l.s, c.s) < least(l.e, c.e) GROUP BY c.ep, c.speaker, c.idx, c.s)
SELECT ep, speaker, string_agg(t, '。' ORDER BY s, idx) AS transcript FROM sg WHERE t <> '' GROUP BY ep, speaker""")
def reference_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the chosen segments of each kept speaker, from the phrases under its name."""
    merged, named, kept = _labelled(spark, sf_dir)
    said = LB.label_by_overlap(B.phrases(spark, sf_dir).where("text IS NOT NULL"), kept, named)
    labels = named.select("ep", F.col("speaker").alias("_label"), F.col("name").alias("speaker"))
    chosen = LB.top_up(LB.clean_segments(merged)).join(named.select("ep", "speaker", "name"), ["ep", "speaker"])
    got = LB.reference_transcript(chosen.select("ep", "idx", "s", "e", F.col("name").alias("speaker")), said)
    return got.join(labels, ["ep", "speaker"]).select("ep", F.col("_label").alias("speaker"), "transcript")


_TURNS = """old AS (SELECT *, lag(speaker) OVER w AS psp, lag(e) OVER w AS pe, row_number() OVER w AS rn FROM uni WINDOW w AS (PARTITION BY ep ORDER BY idx)),
turned AS (SELECT *, sum(CASE WHEN rn > 1 AND speaker IS NOT DISTINCT FROM psp AND s - pe <= 2500 THEN 0 ELSE 1 END) OVER (PARTITION BY ep ORDER BY idx)::BIGINT - 1 AS turn_id FROM old),
turns AS (SELECT ep, turn_id, min(speaker) AS speaker, arg_min(s, idx) AS s, max(e) AS e, count(*) AS n_units FROM turned GROUP BY ep, turn_id)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = I.coalesce_turns(B.units(spark, sf_dir).select("ep", "idx", "s", "e", "speaker"))
    return numbered.groupBy("ep", "turn_id").agg(
        F.min("speaker").alias("speaker"), F.min_by("s", "idx").alias("s"), F.max("e").alias("e"), F.count("*").alias("n_units")
    )


@query(f"WITH {B.UNI}, {_TURNS} SELECT ep, turn_id, speaker, s, e, n_units FROM turns")
def turn_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir)


@query(f"""WITH {B.UNI}, {_TURNS}, {B.SEG}, {B.MERGED},
sp AS (SELECT ep, s, e FROM merged),
b AS (SELECT t.ep, t.turn_id, max(CASE WHEN p.s >= t.s - 1500 AND p.s <= t.s + 300 THEN p.s END) AS onset
  FROM turns t JOIN sp p ON p.ep = t.ep AND (p.s BETWEEN t.s - 1500 AND t.s + 300 OR (p.s <= t.s AND t.s <= p.e)) GROUP BY t.ep, t.turn_id)
SELECT t.ep, t.turn_id, t.s, CASE WHEN b.onset IS NOT NULL AND abs(b.onset - 50 - t.s) > 50 THEN greatest(0, b.onset - 50) ELSE t.s END AS snapped
FROM turns t JOIN b ON b.ep = t.ep AND b.turn_id = t.turn_id""")
def onset_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = B.merged_segments(spark, sf_dir).select("ep", "s", "e")
    return LB.snap_to_onsets(_turns(spark, sf_dir).select("ep", "turn_id", "s"), speech)


@query("""WITH c AS (SELECT DISTINCT ep, idx, batch_index AS turn_id, model_id AS speaker, CAST(round(timestamp_s * 1000) AS BIGINT) AS s FROM translate_events),
g AS (SELECT *, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY ep ORDER BY idx) - 1 AS run FROM (SELECT *, coalesce(turn_id = lag(turn_id) OVER (PARTITION BY ep ORDER BY idx), false) AS o FROM c)),
t AS (SELECT ep, CAST(run AS BIGINT) AS run, min(turn_id) AS turn_id, arg_min(speaker, idx) AS speaker, arg_min(s, idx) AS s, max(s) AS e, count(*) AS n_chunks, count(DISTINCT coalesce(speaker, chr(0))) > 1 AS mixed FROM g GROUP BY ep, run)
SELECT *, row_number() OVER (PARTITION BY ep, turn_id ORDER BY run) > 1 AS reappears FROM t""")
def logical_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translation log regrouped: its batches are the turns, their models the speakers; batches logged again reappear."""
    log = table(spark, sf_dir, "translate_events").select("ep", "idx", F.col("batch_index").alias("turn_id"), F.col("model_id").alias("speaker"), F.round(F.col("timestamp_s") * 1000).cast("bigint").alias("s")).distinct()
    return I.logical_turns(log.withColumn("e", F.col("s")), ["idx"])


@query(f"""WITH {B.PHR}
SELECT ep, idx, coalesce(string_agg(text, ' ') OVER (PARTITION BY ep ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM phr""")
def previous_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.preceding_context(B.phrases(spark, sf_dir), "text").select("ep", "idx", "context")


@query("""WITH v AS (SELECT event_type AS ep, CAST(day(ts) AS INT) AS phrase, event_id AS word_no, hour(ts) // 6 AS s FROM events),
f AS (SELECT *, lag(s) OVER w AS ps FROM v WINDOW w AS (PARTITION BY ep, phrase ORDER BY word_no)),
g AS (SELECT *, sum(CASE WHEN s = ps THEN 0 ELSE 1 END) OVER (PARTITION BY ep, phrase ORDER BY word_no) AS r FROM f)
SELECT ep, phrase, CAST(min(s) AS BIGINT) AS at, count(*) AS n_words FROM g GROUP BY ep, phrase, r HAVING count(*) > 8""")
def collapsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of more than eight events of a type in one quarter of a day, as zero-length words of a phrase (the words of
    the phrases have none)."""
    at = F.expr("hour(ts) div 6").cast("bigint")
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("ep"), F.dayofmonth("ts").alias("phrase"), F.col("event_id").alias("word_no"), at.alias("s"), at.alias("e"))
    return I.collapsed_runs(ev)


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    dur = (word_count(F.col("target_text")) * 400 + 200).cast("bigint")
    return B.units(spark, sf_dir).select("ep", "idx", F.col("s").alias("cue"), dur.alias("dur"), "e")


@query(f"""WITH {B.UNI},
t AS (SELECT ep, idx, s AS cue, {B.n_words('target_text')} * 400 + 200 AS dur FROM uni),
r AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(dur + 250) OVER (PARTITION BY ep ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM t WINDOW w AS (PARTITION BY ep ORDER BY idx))
SELECT ep, idx, cue, CAST(dur AS BIGINT) AS dur, CAST(max((CASE WHEN rn = 1 THEN cue ELSE cue - 1500 END) - bef) OVER (PARTITION BY ep ORDER BY idx) + bef AS BIGINT) AS start FROM r""")
def placement_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.max_plus_starts(_cues(spark, sf_dir).drop("e")).select("ep", "idx", "cue", "dur", "start")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cues(spark, sf_dir)
    total = rows.groupBy("ep").agg((F.max_by("e", "idx") + 500).alias("total"))
    return rows.join(total, "ep").select("ep", "idx", "cue", "dur", F.array((F.col("dur") / 10).cast("bigint")).alias("pauses"), "total")


@query(Q.SIMULATE)
def simulate_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.simulate_placement(_timed(spark, sf_dir))


@query(Q.TIMELINE_FIT)
def timeline_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evaluate_timeline(_timed(spark, sf_dir))


@query(Q.PHRASE_GROUP)
def phrase_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = B.words(spark, sf_dir).where("word IS NOT NULL").select("ep", "idx", "word_no", F.col("ws").alias("s"), F.col("we").alias("e"), "word")
    return S.group_phrases(words, order=("idx", "word_no"))


@query(Q.SUBTITLE_UNITS)
def subtitle_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = B.units(spark, sf_dir).select("ep", "idx", "s", "e", "speaker", F.col("target_text").alias("text"))
    n = F.aggregate("frames", F.lit(0).cast("bigint"), lambda a, x: a + x["until"] - x["first"])
    return S.sentence_units(cues).withColumn("n_frames", n).drop("frames")


@query(f"""WITH RECURSIVE {_KEPT}, {_CUTS}, {B.WRD}, {_BUCKETS}, {_PIECES}, {Q.ORPHANS}
SELECT ep, p.idx AS idx, p.bucket AS bucket, p.s AS s, p.e AS e, p.speaker AS speaker, p.text AS text, CAST(p.n_words AS INT) AS n_words, p.m AS n_merged FROM pieces_out""")
def label_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelling of a job from end to end: merge, noise filter, names, handoff cuts, labels of the pieces, orphans."""
    merged = S.merge_orphans(_pieces(spark, sf_dir))
    return merged.select("ep", "idx", "bucket", "s", "e", "speaker", "text", F.size("words").alias("n_words"), "n_merged")


@query(Q.TURN_CHUNKS)
def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.turn_chunks(B.units(spark, sf_dir))


@query(f"""WITH {B.UNI}
SELECT ep, arg_max(e, idx) + 500 AS last_horizon, max(e) + 500 AS max_horizon FROM uni GROUP BY ep""")
def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.units(spark, sf_dir).groupBy("ep").agg((F.max_by("e", "idx") + 500).alias("last_horizon"), (F.max("e") + 500).alias("max_horizon"))


@query(f"""WITH {B.PHR} SELECT p.ep, p.idx FROM phr p JOIN (SELECT DISTINCT ep, window_s FROM jobs) j ON j.ep = p.ep WHERE coalesce(j.window_s, 0) = 0 OR p.s < j.window_s * 1000""")
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select("ep", "window_s").distinct()
    return B.phrases(spark, sf_dir).join(jobs, "ep").where("coalesce(window_s, 0) = 0 OR s < window_s * 1000").select("ep", "idx")


@query(f"""WITH {B.PHR}, lim AS (SELECT ep, (max(e) + 999) // 1000 AS total FROM phr GROUP BY ep)
SELECT ep, CAST(k AS INT) AS chunk, CAST(k * 100 AS BIGINT) AS start, CAST(least(100, total - k * 100) AS BIGINT) AS length
FROM (SELECT ep, total, unnest(range(0, CAST(ceil(total / 100.0) AS BIGINT))) AS k FROM lim WHERE total > 0)""")
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lim = B.phrases(spark, sf_dir).groupBy("ep").agg(F.expr("(max(e) + 999) div 1000").alias("total")).where("total > 0")
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("total") / 100.0) - 1))
    return lim.select("ep", "total", k.alias("k")).select(
        "ep", F.col("k").cast("int").alias("chunk"), (F.col("k") * 100).alias("start"), F.least(F.lit(100), F.col("total") - F.col("k") * 100).alias("length")
    )


@query(Q.TURN_REPORT)
def turn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the chunks: texts joined in order, the last chunk's end, number of parts."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part_index", "text"))), lambda x: x["text"])
    return S.turn_chunks(B.units(spark, sf_dir)).groupBy("ep", "turn_id").agg(
        F.first("speaker").alias("speaker"), F.min("s").alias("s"), F.max_by("e", "part_index").alias("e"), F.concat_ws(" ", parts).alias("text"), F.count("*").alias("n_parts")
    )


@query("""WITH u AS (SELECT DISTINCT ep, speaker FROM speaker_phrases WHERE speaker IS NOT NULL)
SELECT ep, speaker FROM u WHERE NOT EXISTS (SELECT 1 FROM speaker_refs r WHERE r.ep = u.ep AND r.speaker = u.speaker)""")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of the imported transcript, as they are written there, without a reference."""
    used = table(spark, sf_dir, "speaker_phrases").where("speaker IS NOT NULL").select("ep", "speaker")
    return C.missing_keys(used, table(spark, sf_dir, "speaker_refs"), ["ep", "speaker"])
