"""Frame, mask and sample queries: the coverage gate on event levels, sample work on embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import signal as G
from tidemark.plans.registry import query, table

_FRAMES = 48


def _levels(spark: SparkSession, sf_dir: str, *tracks: str) -> DataFrame:
    """Dense half-hour levels (day, frame, and a column for each event type) from one scan; empty frames are 0."""
    at = (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("int")
    ev = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), at.alias("frame"), "event_type", "value")
    value = F.col("value").cast("double")
    levels = [F.sqrt(F.avg(F.when(F.col("event_type") == t, value * value))).alias(t) for t in tracks]
    frames = ev.groupBy("day", "frame").agg(*levels)
    filled = frames.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("frame", F.struct(*tracks).alias("v")))).alias("at"))
    dense = filled.select("day", "at", F.explode(F.sequence(F.lit(0), F.lit(_FRAMES - 1))).alias("frame"))
    return dense.select("day", "frame", *[F.coalesce(F.col("at")[F.col("frame")][t], F.lit(0.0)).alias(t) for t in tracks])


def _sql_levels(name: str, track: str) -> str:
    return f"""{name}_l AS (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) * 2 + minute(ts) // 30 AS INT) AS frame, sqrt(avg(value * value)) AS rms FROM events WHERE event_type = '{track}' GROUP BY 1, 2),
{name} AS (SELECT d.day, d.frame, coalesce(l.rms, 0) AS rms FROM days d LEFT JOIN {name}_l l ON l.day = d.day AND l.frame = d.frame)"""


_DAYS = "days AS (SELECT day, CAST(k AS INT) AS frame FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), range(0, 48) r(k))"
_ACT = "{0}_a AS (SELECT day, frame, CAST(rms > greatest({1}, median(rms) OVER (PARTITION BY day)) AS INT) AS active FROM {0})"
_GATE = f"""{_DAYS}, {_sql_levels('orig', 'view')}, {_sql_levels('dub', 'click')}, {_ACT.format('orig', 0.006)}, {_ACT.format('dub', 0.005)},
m AS (SELECT o.day, o.frame, o.active AS o, max(d.active) OVER (PARTITION BY o.day ORDER BY o.frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near
  FROM orig_a o JOIN dub_a d ON d.day = o.day AND d.frame = o.frame)"""


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = G.activity(_levels(spark, sf_dir, "view", "click"), ["day"], 0.006, 1.0, "view", "original")
    return G.activity(both, ["day"], 0.005, 1.0, "click", "dub")


@query(f"""WITH {_GATE},
dead AS (SELECT day, max(n) AS longest FROM (SELECT day, count(*) AS n FROM (SELECT day, frame, frame - row_number() OVER (PARTITION BY day ORDER BY frame) AS g FROM m WHERE o = 1 AND near = 0) GROUP BY day, g) GROUP BY day)
SELECT m.day, round(sum(o * near) / greatest(sum(o), 1), 6) AS coverage, CAST(coalesce(max(longest), 0) AS BIGINT) AS longest_dead FROM m LEFT JOIN dead ON dead.day = m.day GROUP BY m.day""")
def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = G.coverage_gate(_masks(spark, sf_dir), ["day"], "frame", 1)
    return gate.select("day", F.round("coverage", 6).alias("coverage"), "longest_dead")


@query(f"WITH {_DAYS}, {_sql_levels('orig', 'view')} SELECT day, frame, round(rms, 6) AS rms FROM orig")
def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, "view").select("day", "frame", F.round("view", 6).alias("rms"))


@query(f"WITH {_GATE} SELECT day, frame, o AS active, near FROM m")
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = G.dilate(_masks(spark, sf_dir), ["day"], "frame", "dub", 1, "near")
    return near.select("day", "frame", F.col("original").alias("active"), "near")


@query(f"""WITH {_DAYS}, {_sql_levels('orig', 'view')}, {_ACT.format('orig', 0.006)}
SELECT day, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS length FROM (SELECT day, frame, frame - row_number() OVER (PARTITION BY day ORDER BY frame) AS g FROM orig_a WHERE active = 1) GROUP BY day, g""")
def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.true_runs(_masks(spark, sf_dir), ["day"], "frame", F.col("original") == 1)


_VEC = "v AS (SELECT vec_id, embedding FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


_SIL = f"""{_VEC}, s AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM v),
f AS (SELECT vec_id, CAST(pos // 4 AS INT) AS frame, sqrt(avg(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS rms FROM s GROUP BY 1, 2)"""


@query(f"""WITH {_SIL}
SELECT vec_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS length FROM (SELECT vec_id, frame, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS g FROM f WHERE rms < 0.12) GROUP BY vec_id, g HAVING count(*) >= 2""")
def silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    levels = G.frame_levels(samples.select("vec_id", F.floor(F.col("pos") / 4).cast("int").alias("frame"), "x"), ["vec_id"], "frame", "x")
    return G.silent_runs(levels, ["vec_id"], "frame", 0.12, 2)


@query("""WITH s AS (SELECT ep, speaker, e - s AS len FROM (SELECT ep, speaker, s, lead(s) OVER (PARTITION BY ep, speaker ORDER BY s, e) AS e FROM (
    SELECT DISTINCT ep, speaker, CAST(round(end_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e FROM speaker_phrases WHERE isfinite(end_s) AND speaker IS NOT NULL)) WHERE e > s),
t AS (SELECT *, sum(len) OVER (PARTITION BY ep, speaker)::BIGINT AS total FROM s)
SELECT ep, speaker, len, total, least(len, 120) AS compressed, round(CASE WHEN total < 100 THEN len ELSE least(len * least(1.0 + 5000.0 / total, 2.0), 1500.0) END, 3) AS stretched FROM t""")
def pause_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from tidemark.operators.periods import to_ms

    ends = table(spark, sf_dir, "speaker_phrases").where("speaker IS NOT NULL").select("ep", "speaker", to_ms(F.col("end_s")).alias("s")).where("s IS NOT NULL").distinct()
    w = Window.partitionBy("ep", "speaker")
    gaps = ends.withColumn("len", F.lead("s").over(w.orderBy("s")) - F.col("s")).where("len > 0").withColumn("total", F.sum("len").over(w))
    return gaps.select(
        "ep", "speaker", "len", "total", G.compressed(F.col("len")).alias("compressed"), F.round(G.stretched(F.col("len"), F.col("total"), F.lit(5000)), 3).alias("stretched")
    )


@query(f"WITH {_VEC} SELECT vec_id, CAST(len(embedding) * 2 + 5 AS INT) AS n, round(list_sum(embedding) * 2, 3) AS total FROM v")
def join_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<float>")
    joined = _vectors(spark, sf_dir).select("vec_id", G.join_with_silence(F.array(v, v), 5).alias("j"))
    total = F.aggregate("j", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return joined.select("vec_id", F.size("j").alias("n"), F.round(total, 3).alias("total"))


@query(f"""WITH {_VEC}, p AS (SELECT vec_id // 10 AS grp, (vec_id % 10) * 8 + generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM v)
SELECT grp, CAST(pos AS INT) AS pos, round(sum(CAST(x AS DOUBLE)), 5) AS value FROM p WHERE pos < 100 GROUP BY 1, 2""")
def mix_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = _vectors(spark, sf_dir).select(F.expr("vec_id div 10").alias("grp"), ((F.col("vec_id") % 10) * 8).cast("int").alias("off"), "embedding")
    return G.mix_add(tracks, ["grp"], "off", "embedding", 100).select("grp", F.col("pos").cast("int").alias("pos"), F.round("value", 5).alias("value"))


@query(f"""WITH {_VEC}, p AS (SELECT vec_id // 10 AS grp, (vec_id % 10) * 8 + generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM v),
m AS (SELECT grp, pos, sum(CAST(x AS DOUBLE)) AS value FROM p WHERE pos < 100 GROUP BY 1, 2), t AS (SELECT *, max(abs(value)) OVER (PARTITION BY grp) AS top FROM m)
SELECT grp, CAST(pos AS INT) AS pos, round(value, 5) AS value, CAST(trunc(least(1.0, greatest(-1.0, CASE WHEN top > 0.89 THEN value * 0.89 / top ELSE value END)) * 32767) AS INT) AS pcm FROM t""")
def peak_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = _vectors(spark, sf_dir).select(F.expr("vec_id div 10").alias("grp"), ((F.col("vec_id") % 10) * 8).cast("int").alias("off"), "embedding")
    done = G.normalise(G.mix_add(tracks, ["grp"], "off", "embedding", 100), ["grp"])
    return done.select("grp", F.col("pos").cast("int").alias("pos"), F.round("value", 5).alias("value"), "pcm")


@query(f"""WITH {_VEC} SELECT vec_id, CAST(least(len(embedding), greatest(0, (vec_id % 10) * 8 + len(embedding) - 100)) AS INT) AS trimmed FROM v""")
def mix_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each track that the mix cuts off."""
    tracks = _vectors(spark, sf_dir).select("vec_id", ((F.col("vec_id") % 10) * 8).cast("int").alias("off"), "embedding")
    return G.trimmed(tracks, "off", "embedding", 100).select("vec_id", "trimmed")


@query("""WITH u AS (SELECT DISTINCT ep, idx, end_s - start_s AS d, len(string_split_regex(trim(coalesce(target_text, '')), '[ ]+')) * 0.4 AS f FROM translation_units WHERE isfinite(start_s) AND isfinite(end_s))
SELECT ep, idx, round(f / d, 6) AS misfit, f / d > 1.2 OR f / d < 0.9 AS rewrite FROM u WHERE d > 0""")
def misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far spoken units would miss their spans, and whether that is beyond fitting."""
    big = F.lit(float("inf"))
    rows = table(spark, sf_dir, "translation_units").where((F.abs("start_s") < big) & (F.abs("end_s") < big) & ~F.isnan("start_s") & ~F.isnan("end_s"))
    f = F.size(F.split(F.trim(F.coalesce("target_text", F.lit(""))), "[ ]+")) * 0.4
    rows = rows.select("ep", "idx", (F.col("end_s") - F.col("start_s")).alias("d"), f.alias("f")).distinct().where("d > 0")
    return rows.select("ep", "idx", F.round(G.misfit(F.col("f"), F.col("d")), 6).alias("misfit"), G.needs_rewrite(F.col("f"), F.col("d")).alias("rewrite"))

@query()
def fit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<float>").alias("samples"), F.lit(0.05).alias("window_s"))
    return G.fit_vectors(rows, "samples", "window_s", 400).select("vec_id", "notes", F.size("fitted").alias("n"))
