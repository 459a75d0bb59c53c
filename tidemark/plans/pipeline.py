"""The speech-fitting stage, with deterministic stand-ins for the model calls.

It starts from the given translated units: window filter, turns, onset snapping, and the fit loop, which
measures, rewrites and measures again for at most three rounds in one stream over the turns of an episode.
The stages before it (words, labels, references) and after it (placement, cues, gate) are separate queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import labelling as LB
from tidemark.operators import scans as S
from tidemark.plans import base as B
from tidemark.plans.registry import query, table

MS_A_WORD = 400
ROUNDS = 3


def units_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that start before their job's window_s, where it has one, with `total`, the episode's horizon in
    ms: the window, or the last unit's end and 500 ms."""
    jobs = table(spark, sf_dir, "jobs").select("ep", F.when(F.col("window_s") != 0, (F.col("window_s") * 1000).cast("bigint")).alias("window")).distinct()
    rows = B.units(spark, sf_dir).join(jobs, "ep", "left").where("window IS NULL OR s < window")
    last = rows.groupBy("ep").agg(F.coalesce(F.max("window"), F.max_by("e", "idx") + 500).alias("total"))
    return rows.drop("window").join(last, "ep")


def snapped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn chunks whose first parts start at a speech onset, with the horizon; turns without speech nearby are dropped.

    An episode without any diarized speech keeps its turns as they are.
    """
    units = units_in_window(spark, sf_dir)
    chunks = S.turn_chunks(units.drop("total"))
    speech = B.merged_segments(spark, sf_dir, once=True).select("ep", "s", "e")
    first = chunks.where("part_index = 0").select("ep", "turn_id", "s")
    heard = speech.select("ep").distinct()
    snapped = LB.snap_to_onsets(first, speech).select("ep", "turn_id", "snapped")
    silent = first.join(heard, "ep", "left_anti").select("ep", "turn_id", F.col("s").alias("snapped"))
    kept = chunks.join(snapped.unionByName(silent), ["ep", "turn_id"])
    shift = F.when(F.col("part_index") == 0, F.col("snapped") - F.col("s")).otherwise(0)
    kept = kept.join(units.select("ep", "total").distinct(), "ep")
    return kept.withColumn("s", F.col("s") + shift).withColumn("e", F.greatest(F.col("e") + shift, F.col("s") + 1)).drop("snapped")


def spoken(counts: list[int]) -> tuple[int, list[int]]:
    """Stand-in duration of a turn with these words in its chunks, and its pauses: one between chunks, and one after
    every ten words."""
    pauses = [150] * (len(counts) - 1) + [300] * (sum(counts) // 10)
    return sum(counts) * MS_A_WORD + (len(counts) - 1) * 150 + 100, pauses


def fit_loop(
    chunks: DataFrame, rounds: int = ROUNDS, spoken: S.Measurer = spoken, rewrite: S.Rewriter = lambda counts, budgets: budgets
) -> tuple[DataFrame, DataFrame]:
    """(chunks, assessment) after at most `rounds` rewrites of the turns that miss their windows.

    `spoken` measures and `rewrite` rewrites a turn; the stand-ins speak at a fixed rate and meet their budgets.
    Budgets are those of `scans.rewrite_budgets`.
    """
    # without a horizon the last end counts: a window, as a join would compute the chunks twice
    total = F.col("total") if "total" in chunks.columns else F.max("e").over(Window.partitionBy("ep")) + 500
    fitted = S.fit_turns(chunks.select("ep", "turn_id", "part_index", "s", "n_words", total.alias("total")), rounds, spoken, rewrite)
    words = fitted.select("ep", F.col("idx").cast("int").alias("turn_id"), F.posexplode("counts").alias("part_index", "n_words"))
    return chunks.drop("n_words").join(words, ["ep", "turn_id", "part_index"]), fitted.drop("counts")


@query()
def pipeline_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_loop(snapped_chunks(spark, sf_dir))[1]
