"""Text, budget, audit and rendering queries on the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import checks as C
from tidemark.operators.scans import pack_sentences
from tidemark.plans import base as B
from tidemark.plans.registry import query, table
from tidemark.plans.sequential import SENTENCE_PACK
from tidemark.sources import artifacts as A
from tidemark.sources.media import html_row, speaker_colours, srt_rows


@query(f"""WITH {B.UNI} SELECT ep, idx, CAST({B.n_words('source_text')} AS INT) AS source_words, CAST({B.n_words('target_text')} AS INT) AS target_words FROM uni""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.units(spark, sf_dir).select("ep", "idx", T.word_count(F.col("source_text")).alias("source_words"), T.word_count(F.col("target_text")).alias("target_words"))


@query(f"""WITH {B.UNI} SELECT ep, idx, greatest(1, CAST(round_even((e - s) / 1000.0 * 2.5, 0) AS INT)) AS budget FROM uni""")
def word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.units(spark, sf_dir).select("ep", "idx", T.word_budget((F.col("e") - F.col("s")) / 1000.0).alias("budget"))


@query(f"""WITH {B.UNI}, b AS (SELECT ep, idx, greatest(1, CAST(round_even((e - s) / 1000.0 * 2.5, 0) AS INT)) AS budget, CAST({B.n_words('target_text')} AS INT) AS words FROM uni)
SELECT ep, idx, budget, words, CASE WHEN words <= 0 THEN 0.0 ELSE round(1.0 / (1.0 + power(abs(words - budget) / greatest(1.0, 0.05 * budget), 2)), 6) END AS reward FROM b""")
def fit_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.units(spark, sf_dir).select(
        "ep", "idx", T.word_budget((F.col("e") - F.col("s")) / 1000.0).alias("budget"), T.word_count(F.col("target_text")).alias("words")
    )
    return rows.withColumn("reward", F.round(T.fit_reward(F.col("words"), F.col("budget")), 6))


_W = f"""w AS (SELECT ep, idx, CAST({B.n_words('target_text')} AS INT) AS lower, CAST({B.n_words('target_text')} AS INT) + 1 + (idx % 7) AS upper FROM uni WHERE target_text IS NOT NULL)"""


@query(f"""WITH {B.UNI}, {_W}
SELECT ep, idx, lower, CAST(upper AS INT) AS upper, CAST(least(275, greatest(1, CASE WHEN upper - lower > 1 THEN least(upper - 1, greatest(lower + 1, CAST(round_even(lower + 0.5 * (upper - lower), 0) AS INT)))
  ELSE CAST(round_even(lower + 0.5 * (upper - lower), 0) AS INT) END)) AS INT) AS budget FROM w""")
def budget_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.units(spark, sf_dir).where("target_text IS NOT NULL").select("ep", "idx", T.word_count(F.col("target_text")).alias("lower"))
    rows = rows.withColumn("upper", (F.col("lower") + 1 + F.col("idx") % 7).cast("int"))
    return rows.withColumn("budget", T.interpolated_budget(F.col("lower"), F.col("upper"), F.lit(0.5)))


@query(f"""WITH {B.UNI}, {_W}
SELECT ep, idx, greatest(4, CAST(round_even(lower * 0.8 * 0.95, 0) AS INT)) AS budget FROM w""")
def tighter_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.units(spark, sf_dir).where("target_text IS NOT NULL")
    return rows.select("ep", "idx", T.tighter_budget(T.word_count(F.col("target_text")), F.lit(0.8), F.lit(4)).alias("budget"))


@query(f"""WITH {B.UNI}, n AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY s, idx) AS seq FROM uni WHERE length(target_text) > 0)
SELECT ep, CAST(seq AS INT) AS seq, seq || chr(10)
  || printf('%02d:%02d:%02d,%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) || ' --> '
  || printf('%02d:%02d:%02d,%03d', e // 3600000, e // 60000 % 60, e // 1000 % 60, e % 1000) || chr(10) || target_text || chr(10) || chr(10) AS block FROM n""")
def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = B.units(spark, sf_dir).where("length(target_text) > 0").withColumnRenamed("target_text", "text")
    return srt_rows(cues, order=("s", "idx"))


@query(f"""WITH {B.UNI}, f AS (SELECT ep, speaker, row_number() OVER (PARTITION BY ep ORDER BY min(idx), speaker) - 1 AS k FROM uni WHERE speaker IS NOT NULL GROUP BY ep, speaker)
SELECT u.ep, u.idx, '<tr class="c' || (f.k % 8) || '"><td>' || replace(replace(replace(replace(replace(u.speaker, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td><td>'
  || replace(replace(replace(replace(replace(u.target_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td></tr>' AS html
FROM uni u JOIN f ON f.ep = u.ep AND f.speaker = u.speaker WHERE u.target_text IS NOT NULL""")
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.units(spark, sf_dir).where("speaker IS NOT NULL")
    joined = rows.where("target_text IS NOT NULL").join(speaker_colours(rows), ["ep", "speaker"])
    return joined.select("ep", "idx", html_row(F.col("speaker"), F.col("colour"), F.col("target_text")).alias("html"))


@query(f"""WITH {B.UNI} SELECT ep, idx, sha1('ns' || chr(0) || CAST(10 AS VARCHAR) || chr(0) || source_text) AS key FROM uni WHERE source_text IS NOT NULL""")
def rewrite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.units(spark, sf_dir).where("source_text IS NOT NULL")
    return rows.select("ep", "idx", T.rewrite_key(F.lit("ns"), F.lit(10), F.col("source_text")).alias("key"))


@query(f"""WITH {B.UNI} SELECT ep, idx, printf('turn_%03d_', idx) || substr(sha256(coalesce(target_text, '')), 1, 12) || '.mp3' AS file FROM uni""")
def cache_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.format_string("turn_%03d_", F.col("idx")), F.substring(F.sha2(F.coalesce("target_text", F.lit("")), 256), 1, 12), F.lit(".mp3"))
    return B.units(spark, sf_dir).select("ep", "idx", name.alias("file"))


_PAIRS = "pr AS (SELECT DISTINCT ep, unnest(pairs).id AS id FROM translate_events)"


@query(f"""WITH {_PAIRS}, have AS (SELECT DISTINCT ep, CAST(idx AS INT) AS id FROM phrases), lost AS (SELECT ep, id FROM pr EXCEPT SELECT ep, id FROM have)
SELECT ep, count(*) AS n_missing, list(id ORDER BY id)[1:10] AS first FROM lost GROUP BY ep""")
def missing_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated lines whose phrase is missing: their number in each episode, and the first ten."""
    lines = table(spark, sf_dir, "translate_events").select("ep", F.explode("pairs.id").alias("id"))
    return C.missing_report(lines, table(spark, sf_dir, "phrases").select("ep", F.col("idx").cast("int").alias("id")), "ep", "id")


@query(f"""WITH {_PAIRS}, l AS (SELECT DISTINCT ep, CAST(idx AS INT) AS id FROM phrases)
SELECT ep, id, 'left' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM pr) UNION ALL SELECT ep, id, 'right' FROM (SELECT * FROM pr EXCEPT SELECT * FROM l)""")
def line_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "translate_events").select("ep", F.explode("pairs.id").alias("id"))
    return C.set_audit(table(spark, sf_dir, "phrases").select("ep", F.col("idx").cast("int").alias("id")), have, ["ep", "id"])


@query("""SELECT ep, idx, count(*) AS n_rows FROM diar_segments GROUP BY ep, idx HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_keys(table(spark, sf_dir, "diar_segments"), ["ep", "idx"])


@query("""WITH v AS (SELECT ep, idx, CASE WHEN start_s IS NULL OR end_s IS NULL THEN 'missing' WHEN NOT isfinite(start_s) OR NOT isfinite(end_s) THEN 'not_finite' END AS a,
  CASE WHEN isfinite(start_s) AND isfinite(end_s) AND start_s < 0 THEN 'negative' END AS b, CASE WHEN isfinite(start_s) AND isfinite(end_s) AND end_s <= start_s THEN 'order' END AS c FROM diar_segments)
SELECT ep, idx, concat_ws(',', a, b, c) AS violations FROM v WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL""")
def span_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "diar_segments")
    return rows.select("ep", "idx", F.concat_ws(",", C.span_violations(rows)).alias("violations")).where("violations <> ''")


@query("""WITH g AS (SELECT ep, idx // 8 AS grp, list({'start_s': start_s, 'end_s': end_s} ORDER BY idx, start_s, end_s) AS words, min(start_s) AS start_s, max(end_s) - 1 AS end_s
  FROM (SELECT DISTINCT ep, idx, start_s, end_s FROM diar_segments WHERE isfinite(start_s) AND isfinite(end_s)) GROUP BY ep, idx // 8)
SELECT ep, grp FROM g WHERE len(list_filter(range(2, len(words) + 1), lambda i: words[i].start_s < words[i - 1].start_s)) > 0
  OR len(list_filter(words, lambda x: x.start_s < start_s - 0.001 OR x.end_s > end_s + 0.001)) > 0""")
def word_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of eight segments in order of arrival, checked like the words of a phrase that ends a second too early
    (the words of the phrases break no rule)."""
    big = F.lit(float("inf"))
    rows = table(spark, sf_dir, "diar_segments").select("ep", "idx", "start_s", "end_s").where(~F.isnan("start_s") & ~F.isnan("end_s") & (F.abs("start_s") < big) & (F.abs("end_s") < big)).distinct()
    words = F.transform(F.array_sort(F.collect_list(F.struct("idx", "start_s", "end_s"))), lambda w: F.struct(w["start_s"], w["end_s"]))
    groups = rows.groupBy("ep", F.expr("CAST(idx div 8 AS INT)").alias("grp")).agg(words.alias("words"), F.min("start_s").alias("s"), (F.max("end_s") - 1).alias("e"))
    return groups.where(C.words_out_of_order(F.col("words"), F.col("s"), F.col("e"))).select("ep", "grp")


_LANGS = [("ar", "Arabic"), ("de", "German"), ("en", "English"), ("es", "Spanish"), ("fr", "French"), ("hi", "Hindi"), ("it", "Italian"), ("ja", "Japanese"), ("ko", "Korean"), ("pt", "Portuguese"), ("ru", "Russian"), ("zh", "Chinese")]
_LANG_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _LANGS)


@query(f"""SELECT j.ep, coalesce(l.name, j.source_lang) AS source_name FROM (SELECT DISTINCT ep, source_lang FROM jobs) j
LEFT JOIN (VALUES {_LANG_VALUES}) AS l(code, name) ON l.code = lower(j.source_lang)""")
def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(_LANGS, "code string, name string")  # twelve rows
    jobs = table(spark, sf_dir, "jobs").select("ep", "source_lang").distinct()
    return jobs.join(F.broadcast(dim), F.lower("source_lang") == F.col("code"), "left").select("ep", F.coalesce("name", "source_lang").alias("source_name"))


@query(f"""WITH {B.UNI} SELECT ep, idx, sha256('{{"ep":' || ep || ',"idx":' || idx || ',"s":' || s || ',"e":' || e || '}}') AS digest FROM uni""")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.units(spark, sf_dir).select("ep", "idx", T.digest(F.col("ep"), F.col("idx"), F.col("s"), F.col("e")).alias("digest"))


@query(f"""WITH {B.UNI}, r AS (SELECT ep, idx, CAST(0.5 + (idx % 9) AS DOUBLE) AS ratio FROM uni)
SELECT ep, idx, ratio, CASE WHEN ratio > 8 THEN 'atempo=2.0,atempo=2.0,atempo=2.0,' WHEN ratio > 4 THEN 'atempo=2.0,atempo=2.0,' WHEN ratio > 2 THEN 'atempo=2.0,' ELSE '' END
  || 'atempo=' || printf('%.5f', CASE WHEN ratio > 8 THEN ratio / 8.0 WHEN ratio > 4 THEN ratio / 4.0 WHEN ratio > 2 THEN ratio / 2.0 ELSE ratio END) AS filters FROM r""")
def tempo_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.units(spark, sf_dir).select("ep", "idx", (F.lit(0.5) + F.col("idx") % 9).alias("ratio"))
    return rows.withColumn("filters", T.tempo_chain(F.col("ratio")))


@query(SENTENCE_PACK)
def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of long units; only texts over the limit reach Python."""
    rows = B.units(spark, sf_dir).where(T.word_count(F.col("target_text")) > T.MAX_WORDS)
    pack = F.udf(pack_sentences, "array<string>", useArrow=True)
    return rows.select("ep", "idx", F.posexplode(pack("target_text")).alias("part", "text")).withColumn("n_words", T.word_count(F.col("text")))


@query("""WITH b AS (SELECT event_id, '{"a": [' || props || ', {"auto_map": ' || props || '}], "k": [{"trust_remote_code": {"auto_map": 1}}]}' AS body FROM events)
SELECT event_id, replace(substr(fullkey, 3), '"', '') AS path FROM b, json_tree(body) WHERE key IN ('auto_map', 'trust_remote_code') AND NOT contains(path, 'trust_remote_code')""")
def unsafe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that hold code, found in JSON texts around the properties of the events."""
    body = F.concat(F.lit('{"a": ['), F.col("props"), F.lit(', {"auto_map": '), F.col("props"), F.lit('}], "k": [{"trust_remote_code": {"auto_map": 1}}]}'))
    return C.unsafe_fields(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", ["event_id"])


@query("""WITH v AS (SELECT DISTINCT ep, idx, timestamp_s, batch_index, line_ids, model_id, pairs FROM translate_events WHERE kind = 'translate'),
f AS (SELECT ep, idx, CASE WHEN timestamp_s > 0 THEN NULL ELSE 'timestamp_s' END AS a, CASE WHEN length(model_id) > 0 THEN NULL ELSE 'model' END AS b, CASE WHEN batch_index >= 0 THEN NULL ELSE 'batch_index' END AS c,
  CASE WHEN len(list_distinct(line_ids)) = len(line_ids) THEN NULL ELSE 'ids' END AS d, CASE WHEN list_transform(pairs, lambda x: x.id) = line_ids THEN NULL ELSE 'lines' END AS e,
  CASE WHEN len(list_filter(pairs, lambda x: NOT coalesce(length(x.source_text) > 0 AND length(x.target_text) > 0 AND x.id >= 0, false))) > 0 THEN 'line' END AS g FROM v)
SELECT ep, idx, concat_ws(',', a, b, c, d, e, g) AS faults FROM f WHERE concat_ws(',', a, b, c, d, e, g) <> ''""")
def event_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the translation log that the log's schema refuses, with what is wrong."""
    ev = table(spark, sf_dir, "translate_events").where("kind = 'translate'")
    ev = ev.select("ep", "idx", "kind", "timestamp_s", "batch_index", F.col("line_ids").alias("ids"), F.col("model_id").alias("model"), F.col("pairs").alias("lines")).distinct()
    return ev.select("ep", "idx", F.concat_ws(",", A.event_faults(ev)).alias("faults")).where("faults <> ''")


@query("""SELECT ep, idx, CASE WHEN length(trim(source_text)) >= 3 THEN '' ELSE 'source_text' END || CASE WHEN length(trim(source_text)) >= 3 OR length(trim(target_text)) >= 3 THEN '' ELSE ',' END
  || CASE WHEN length(trim(target_text)) >= 3 THEN '' ELSE 'target_text' END AS blank FROM (
  SELECT DISTINCT ep, idx, coalesce(source_text, '') AS source_text, coalesce(target_text, '') AS target_text FROM translation_units) WHERE NOT (length(trim(source_text)) >= 3 AND length(trim(target_text)) >= 3)""")
def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a text under three characters, and which."""
    rows = table(spark, sf_dir, "translation_units").select("ep", "idx", "source_text", "target_text").distinct()
    return rows.select("ep", "idx", F.concat_ws(",", C.blank_texts(rows, ["source_text", "target_text"], 3)).alias("blank")).where("blank <> ''")


@query("""WITH u AS (SELECT DISTINCT ep, idx, target_text FROM translation_units)
SELECT ep, idx, regexp_matches(coalesce(target_text, ''), '[.!?…。！？]["''”’»)]*\\s*$') AS ends FROM u""".replace("\\\\", "\\"))
def sentence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "translation_units").select("ep", "idx", "target_text").distinct()
    return rows.select("ep", "idx", T.ends_sentence(F.coalesce("target_text", F.lit(""))).alias("ends"))


@query("""SELECT p.ep, p.idx, u.idx AS unit_idx, CAST(length(p.text) AS INT) AS n, CAST(length(u.target_text) AS INT) AS m FROM (SELECT DISTINCT ep, idx, text, row_number() OVER (PARTITION BY ep ORDER BY idx) AS pos FROM (SELECT DISTINCT ep, idx, text FROM phrases)) p
JOIN (SELECT ep, idx, target_text, row_number() OVER (PARTITION BY ep ORDER BY idx) AS pos FROM (SELECT DISTINCT ep, idx, target_text FROM translation_units)) u ON u.ep = p.ep AND u.pos = p.pos""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and units of an episode side by side, as far as both go; the strict join then finds no gap."""
    def placed(name: str, text: str, idx: str, n: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select("ep", "idx", text).distinct()
        return rows.select("ep", F.row_number().over(Window.partitionBy("ep").orderBy("idx")).alias("pos"), F.col("idx").alias(idx), F.length(text).alias(n))

    a, b = placed("phrases", "text", "idx", "n"), placed("translation_units", "target_text", "unit_idx", "m")
    both = a.groupBy("ep").agg(F.max("pos").alias("p")).join(b.groupBy("ep").agg(F.max("pos").alias("q")), "ep").select("ep", F.least("p", "q").alias("most"))
    cut = lambda x: x.join(both, "ep").where("pos <= most").drop("most")
    return C.strict_zip(cut(a), cut(b), ["ep"], "pos").select("ep", "idx", "unit_idx", "n", "m")


@query("""SELECT ep, idx, batch_index, timestamp_s FROM (SELECT *, row_number() OVER (PARTITION BY ep, batch_index ORDER BY idx DESC) AS k
  FROM (SELECT DISTINCT ep, idx, batch_index, timestamp_s FROM translate_events)) WHERE k = 1""")
def latest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last log entry of each batch: what a resumed run reads."""
    w = Window.partitionBy("ep", "batch_index").orderBy(F.desc("idx"))
    rows = table(spark, sf_dir, "translate_events").select("ep", "idx", "batch_index", "timestamp_s").distinct()
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


_STAGES = ("asr", "diarize", "tts")


@query("""WITH s(stage) AS (VALUES ('asr'), ('diarize'), ('tts')), c(choice) AS (VALUES ('auto'), ('cuda'), ('mps'), ('cpu')), b(x) AS (VALUES (true), (false)),
p AS (SELECT stage, choice, h.x AS cuda, m.x AS mps, f.x AS flash, CASE WHEN choice = 'auto' THEN CASE WHEN h.x THEN 'cuda' WHEN m.x AND stage <> 'diarize' THEN 'mps' ELSE 'cpu' END
  WHEN choice = 'cuda' AND NOT h.x OR choice = 'mps' AND (NOT m.x OR stage = 'diarize') THEN 'error' ELSE choice END AS device FROM s, c, b h, b m, b f)
SELECT *, CASE device WHEN 'error' THEN NULL WHEN 'cpu' THEN 'float32' ELSE 'bfloat16' END AS dtype,
  CASE WHEN device = 'error' THEN NULL WHEN device = 'cuda' THEN CASE WHEN flash THEN 'flash_attention_2' ELSE 'sdpa' END ELSE 'eager' END AS attention FROM p""")
def device_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision table of devices: 3 stages x 4 choices x 8 machines, built on the driver."""
    yes = (True, False)
    rows = [(s, c, a, b, f) for s in _STAGES for c in ("auto", "cuda", "mps", "cpu") for a in yes for b in yes for f in yes]
    df = spark.createDataFrame(rows, "stage string, choice string, cuda boolean, mps boolean, flash boolean")
    auto = F.when(F.col("cuda"), "cuda").when(F.col("mps") & (F.col("stage") != "diarize"), "mps").otherwise("cpu")
    bad = ((F.col("choice") == "cuda") & ~F.col("cuda")) | ((F.col("choice") == "mps") & (~F.col("mps") | (F.col("stage") == "diarize")))
    df = df.withColumn("device", F.when(F.col("choice") == "auto", auto).when(bad, "error").otherwise(F.col("choice")))
    df = df.withColumn("dtype", F.when(F.col("device") == "error", None).when(F.col("device") == "cpu", "float32").otherwise("bfloat16"))
    fast = F.when(F.col("flash"), "flash_attention_2").otherwise("sdpa")
    return df.withColumn("attention", F.when(F.col("device") == "error", None).when(F.col("device") == "cuda", fast).otherwise("eager"))
