"""Speakers of phrases and clean reference segments, by interval joins. Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import overlap_join
from tidemark.operators.islands import neighbour

SPLIT_EDGE_MS = 50
SPLIT_HOLD_MS = 400


def speaker_ranks(merged: DataFrame, floor: float = 0.01) -> DataFrame:
    """Speaking time and rank (ep, speaker, total_ms, rank) of speakers with at least `floor` of all time.

    The longest comes first, ties by label; ranks count from 0. The share is of all speakers' time.
    """
    totals = merged.groupBy("ep", "speaker").agg(F.sum(F.col("e") - F.col("s")).alias("total_ms"))
    shared = totals.withColumn("_all", F.sum("total_ms").over(Window.partitionBy("ep")))
    kept = shared.where(F.coalesce(F.col("total_ms") >= floor * F.col("_all"), F.lit(False)) | (F.col("_all") == 0))
    w = Window.partitionBy("ep").orderBy(F.desc("total_ms"), "speaker")
    return kept.withColumn("rank", F.row_number().over(w) - 1).drop("_all")


def named_speakers(ranks: DataFrame, names: DataFrame) -> DataFrame:
    """`ranks` with `name`: the episode's name of that rank (names: ep, rank, name), or spk_ and the rank."""
    given = names.select("ep", "rank", F.col("name").alias("_name")).dropDuplicates(["ep", "rank"])
    return ranks.join(given, ["ep", "rank"], "left").withColumn("name", F.coalesce("_name", F.concat(F.lit("spk_"), F.col("rank").cast("string")))).drop("_name")


def kept_segments(merged: DataFrame, named: DataFrame) -> DataFrame:
    """Merged segments (ep, s, e, idx, speaker) of the speakers that `named` keeps, under their names. Segments of
    the others (noise) are dropped, and what they parted is not merged again."""
    known = named.select("ep", "speaker", F.col("name").alias("_name"))
    return merged.join(known, ["ep", "speaker"]).select("ep", "s", "e", "idx", F.col("_name").alias("speaker"))


def label_by_overlap(spans: DataFrame, kept: DataFrame, named: DataFrame, keys: tuple[str, ...] = ("ep", "idx")) -> DataFrame:
    """Spans (keys, s, e) with the speaker whose segment overlaps them most.

    `kept` are the named segments of `kept_segments`. The first segment wins ties; a span that none overlaps
    gets the name of the episode's first-ranked speaker, or 'spk_0' where there is none.
    """
    return _or_first(spans.join(_best_overlap(spans, kept, keys), list(keys), "left"), named)


def handoff_cuts(phrases: DataFrame, kept: DataFrame) -> DataFrame:
    """Cuts (ep, idx, cut2) where a phrase passes from one speaker to the next; cut2 is twice the cut in ms.

    `kept` are the named segments of `kept_segments`. A cut lies midway between consecutive segments of
    different names, inside the phrase by 50 ms, and both must hold at least 400 ms of it.
    """
    nxt = neighbour(kept, ["s", "e", "idx"], {"_ns": "s", "_ne": "e", "_nsp": "speaker"}).where("_nsp <> speaker")
    cuts = nxt.select("ep", F.col("s").alias("_a0"), F.col("e").alias("_b0"), F.col("_ns").alias("_a1"), F.col("_ne").alias("_b1"), (F.col("e") + F.col("_ns")).alias("cut2"))
    cuts = cuts.withColumn("_at", F.floor(F.col("cut2") / 2)).withColumn("_to", F.col("_at"))
    on = (
        (F.col("cut2") > 2 * (F.col("s") + SPLIT_EDGE_MS))
        & (F.col("cut2") < 2 * (F.col("e") - SPLIT_EDGE_MS))
        & (F.least("_b0", "e") - F.greatest("_a0", "s") >= SPLIT_HOLD_MS)
        & (F.least("_b1", "e") - F.greatest("_a1", "s") >= SPLIT_HOLD_MS)
    )
    pairs = overlap_join(phrases.select("ep", "idx", "s", "e"), cuts, "ep", ("s", "e"), ("_at", "_to"), on)
    return pairs.select("ep", "idx", "cut2").distinct()


def words_by_phrase(words: DataFrame) -> DataFrame:
    """(ep, idx, words): the words (ep, idx, word_no, ws, we, word) of a phrase as structs (word, ws, we) in order."""
    said = F.array_sort(F.collect_list(F.struct("word_no", "word", "ws", "we")))
    return words.groupBy("ep", "idx").agg(F.transform(said, lambda x: F.struct(x["word"].alias("word"), x["ws"].alias("ws"), x["we"].alias("we"))).alias("words"))


def _parts(words: Column, cuts: Column) -> Column:
    """The pieces (bucket, s, e, text, words) of a phrase: a word belongs to the bucket numbered by the cuts before its
    middle; a piece runs from its first word's start to its last word's end. Buckets without words are left out."""
    buckets = F.sequence(F.lit(0), F.size(cuts))
    inside = lambda k: F.filter(words, lambda w: F.size(F.filter(cuts, lambda c: c < w["ws"] + w["we"])) == k)
    held = F.filter(F.transform(buckets, lambda k: F.struct(k.alias("bucket"), inside(k).alias("words"))), lambda x: F.size(x["words"]) > 0)
    return F.transform(
        held,
        lambda x: F.struct(
            x["bucket"].alias("bucket"), F.get(x["words"], F.lit(0))["ws"].alias("s"), F.element_at(x["words"], -1)["we"].alias("e"),
            F.concat_ws("", F.transform(x["words"], lambda w: w["word"])).alias("text"), x["words"].alias("words"),
        ),
    )


def split_at_cuts(words: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pieces (ep, idx, bucket, s, e, n_words, text, words) of phrases with cuts; see `_parts`."""
    lists = cuts.groupBy("ep", "idx").agg(F.collect_set("cut2").alias("_cuts"))
    both = words_by_phrase(words).join(lists, ["ep", "idx"])
    return both.select("ep", "idx", F.inline(_parts(F.col("words"), F.col("_cuts")))).withColumn("n_words", F.size("words").cast("bigint"))


def label_pieces(phrases: DataFrame, kept: DataFrame, named: DataFrame) -> DataFrame:
    """Phrases cut at handoffs, each piece under the speaker of most of it: ep, idx, bucket, s, e, text, words, speaker.

    `phrases` are (ep, idx, s, e, text, words), with words as arrays of structs (word, ws, we) and unique (ep, idx);
    `named` and `kept` come from `named_speakers` and `kept_segments`. A phrase without a cut or without
    words stays one piece with bucket 0, and each piece is labelled by itself. What the joins on time move are
    keys and times; texts and words are only moved to their phrase.
    """
    lists = handoff_cuts(phrases, kept).groupBy("ep", "idx").agg(F.collect_set("cut2").alias("_cuts"))
    whole = F.array(F.struct(F.lit(0).alias("bucket"), "s", "e", "text", "words"))
    uncut = F.col("_cuts").isNull() | F.coalesce(F.size("words") <= 0, F.lit(True))
    parts = F.when(uncut, whole).otherwise(_parts(F.col("words"), F.col("_cuts")))
    cut = phrases.join(lists, ["ep", "idx"], "left")
    spans = cut.select("ep", "idx", F.inline(parts)).select("ep", "idx", "bucket", "s", "e")
    by_piece = _best_overlap(spans, kept, ("ep", "idx", "bucket")).groupBy("ep", "idx").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "_best"))).alias("_said"))
    told = cut.join(by_piece, ["ep", "idx"], "left").select("ep", "idx", "_said", F.inline(parts))
    return _or_first(told.withColumn("_best", F.col("_said")[F.col("bucket")]).drop("_said"), named)


def _best_overlap(spans: DataFrame, kept: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, _best): the speaker whose segment overlaps a span most, for spans that one overlaps; the first wins ties."""
    right = kept.select("ep", F.col("s").alias("_s"), F.col("e").alias("_e"), "speaker")
    on = (F.col("s") < F.col("_e")) & (F.col("_s") < F.col("e"))
    pairs = overlap_join(spans.select(*keys, "s", "e"), right, "ep", ("s", "e"), ("_s", "_e"), on)
    share = F.least("e", "_e") - F.greatest("s", "_s")
    return pairs.where(share > 0).groupBy(*keys).agg(F.min_by("speaker", F.struct(-share, "_s", "_e", "speaker")).alias("_best"))


def _or_first(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows with _best as speaker, else the episode's first-ranked name, else 'spk_0'."""
    top = named.where("rank = 0").select("ep", F.col("name").alias("_top"))
    return rows.join(top, "ep", "left").withColumn("speaker", F.coalesce("_best", "_top", F.lit("spk_0"))).drop("_best", "_top")


def clean_segments(segs: DataFrame, least_ms: int = 4000, most_ms: int = 12000, clear_ms: int = 200) -> DataFrame:
    """Segments of 4 to 12 s that no other speaker comes within 200 ms of; rows keep their columns.

    `segs` needs ep, idx (unique in ep), s, e and speaker.
    """
    cand = segs.where((F.col("e") - F.col("s")).between(least_ms, most_ms))
    other = segs.select("ep", F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("speaker").alias("_sp"))
    on = (F.col("_sp") != F.col("speaker")) & (F.col("_s") < F.col("e") + clear_ms) & (F.col("_e") > F.col("s") - clear_ms)
    hit = overlap_join(cand.select("ep", "idx", "s", "e", "speaker"), other, "ep", ("s", "e"), ("_s", "_e"), on, margin=clear_ms)
    return cand.join(hit.select("ep", "idx").distinct(), ["ep", "idx"], "left_anti")


def top_up(clean: DataFrame, wanted_ms: int = 60_000, least_ms: int | None = None) -> DataFrame:
    """The longest clean segments of each speaker until wanted_ms are reached; ties by start.

    With least_ms a speaker whose chosen segments sum to less fails the job.
    """
    w = Window.partitionBy("ep", "speaker").orderBy(F.desc(F.col("e") - F.col("s")), "s", "idx")
    had = F.coalesce(F.sum(F.col("e") - F.col("s")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = clean.withColumn("_had", had).where(F.col("_had") < wanted_ms).drop("_had")
    if least_ms is None:
        return chosen
    total = F.sum(F.col("e") - F.col("s")).over(Window.partitionBy("ep", "speaker"))
    short = F.concat_ws("", F.lit("only "), F.col("_total").cast("string"), F.lit(" ms of clean speech of "), "speaker")
    return chosen.withColumn("_total", total).where(F.when(F.col("_total") >= least_ms, F.lit(True)).otherwise(F.raise_error(short).cast("boolean"))).drop("_total")


def reference_transcript(chosen: DataFrame, phrases: DataFrame) -> DataFrame:
    """Transcript (ep, speaker, transcript) of chosen segments: each segment's overlapping phrases of the
    same speaker, joined without a separator, segments joined by an ideographic full stop."""
    said = phrases.select("ep", F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("speaker").alias("_sp"), "text", F.col("idx").alias("_i"))
    on = (F.col("_sp") == F.col("speaker")) & (F.greatest("s", "_s") < F.least("e", "_e"))
    pairs = overlap_join(chosen.select("ep", "idx", "s", "e", "speaker"), said, "ep", ("s", "e"), ("_s", "_e"), on)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_s", "_i", "text"))), lambda x: x["text"])
    seg = pairs.groupBy("ep", "speaker", "idx", "s").agg(F.trim(F.concat_ws("", ordered)).alias("t")).where("t <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("s", "idx", "t"))), lambda x: x["t"])
    return seg.groupBy("ep", "speaker").agg(F.concat_ws("。", parts).alias("transcript"))


def snap_to_onsets(turns: DataFrame, speech: DataFrame, back_ms: int = 1500, fwd_ms: int = 300, pad_ms: int = 50) -> DataFrame:
    """Turns (ep, turn_id, s) with `snapped`: 50 ms before the latest onset from 1.5 s before to 0.3 s after the start.

    `speech` are (ep, s, e) stretches. A turn without an onset keeps its start if a stretch holds it and is
    dropped otherwise; shifts of up to 50 ms are not made, and no start falls below 0.
    """
    near = speech.select("ep", F.col("s").alias("_s"), F.col("e").alias("_e"))
    t = turns.select("ep", "turn_id", "s").withColumn("_t", F.col("s"))
    onset = (F.col("_s") >= F.col("s") - back_ms) & (F.col("_s") <= F.col("s") + fwd_ms)
    holds = (F.col("_s") <= F.col("s")) & (F.col("s") <= F.col("_e"))
    pairs = overlap_join(t, near, "ep", ("s", "_t"), ("_s", "_e"), onset | holds, margin=back_ms)
    best = pairs.groupBy("ep", "turn_id").agg(F.max(F.when(onset, F.col("_s"))).alias("_onset"))
    nudge = F.col("_onset") - pad_ms - F.col("s")
    snapped = F.when(F.col("_onset").isNotNull() & (F.abs(nudge) > pad_ms), F.greatest(F.lit(0), F.col("_onset") - pad_ms)).otherwise(F.col("s"))
    return turns.join(best, ["ep", "turn_id"]).withColumn("snapped", snapped).drop("_onset")
