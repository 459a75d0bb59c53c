"""Gaps-and-islands operators over ordered rows of an episode, as window expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.checks import require_none

UNBOUNDED = Window.unboundedPreceding


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of each key from 0; `starts` is true on a row that opens one (null: false)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    opened = F.when(F.row_number().over(w) == 1, 1).when(starts, 1).otherwise(0)
    # two steps: a window can't be nested in another one
    flagged = df.withColumn("_open", opened)
    return flagged.withColumn(name, F.sum("_open").over(w.rowsBetween(UNBOUNDED, 0)) - 1).drop("_open")


#: Rows of an episode (by their number) or milliseconds of it that are worked together.
BLOCK_ROWS, STRETCH_MS = 4096, 600_000


def _blocks(rows: DataFrame, order: list[str], block: int) -> DataFrame:
    """The rows with `_b`, the block of the first order column, spread by episode and block. The explicit exchange is
    shared by all that is derived from the result."""
    return rows.withColumn("_b", F.expr(f"CAST({order[0]} AS BIGINT) div {block}")).repartition("ep", "_b")


def neighbour(rows: DataFrame, order: list[str], values: dict[str, str], block: int = STRETCH_MS, ahead: bool = True) -> DataFrame:
    """Add the values {new name: column} of the next row of the episode in order (ahead) or of the one before.

    The first of `order` is a number; the episode is worked in blocks of it, and only the first and last rows of
    a block meet in one window, so a hot episode is spread over many tasks.
    """
    shift = F.lead if ahead else F.lag
    w = Window.partitionBy("ep", "_b").orderBy(*order)
    told = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    near = _blocks(rows, order, block).withColumn("_own", told).withColumn("_next", F.lead("_own").over(w)).withColumn("_k", F.row_number().over(w))
    near = near.withColumn("_near", F.col("_next") if ahead else F.lag("_own").over(w))
    # what moves on is the neighbour found, and of an edge its own values
    edge = (F.col("_k") == 1) | F.col("_next").isNull()
    placed = near.select(*rows.columns, "_b", "_near", F.when(edge, F.col("_own")).alias("_own"), F.when(edge, F.lit(-1)).otherwise(F.col("_b")).alias("_place"))
    v = Window.partitionBy("ep", "_place").orderBy("_b", *order)
    # a null in the block means the neighbour lies beyond it: it is the next edge
    far = placed.withColumn("_met", F.coalesce("_near", F.when(F.col("_place") == -1, shift("_own").over(v))))
    return far.select(*rows.columns, *[F.col(f"_met.{n}").alias(n) for n in values])


def running(rows: DataFrame, order: list[str], totals: dict[str, Column], block: int = BLOCK_ROWS, most: bool = False) -> DataFrame:
    """Add the running totals {new name: value} of the episode in order, or with `most` the running maxima; each
    row's own value counts.

    The first of `order` is a number. Blocks of it are summed where they lie, what the blocks before it come to is
    one row a block, and no window holds the rows of a whole episode.
    """
    agg = F.max if most else F.sum
    spread = _blocks(rows.select("*", *[v.alias(f"_v_{n}") for n, v in totals.items()]), order, block)
    sums = spread.groupBy("ep", "_b").agg(*[agg(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    v = Window.partitionBy("ep").orderBy("_b").rowsBetween(UNBOUNDED, -1)
    before = sums.select("ep", "_b", *[agg(f"_s_{n}").over(v).alias(f"_s_{n}") for n in totals])
    w = Window.partitionBy("ep", "_b").orderBy(*order).rowsBetween(UNBOUNDED, 0)
    local = spread.select("*", *[agg(f"_v_{n}").over(w).alias(f"_l_{n}") for n in totals])
    joined = local.join(before, (local["ep"].eqNullSafe(before["ep"])) & (local["_b"] == before["_b"])).drop(before["ep"]).drop(before["_b"])
    both = (lambda n: F.greatest(f"_l_{n}", f"_s_{n}")) if most else (lambda n: F.col(f"_l_{n}") + F.coalesce(f"_s_{n}", F.lit(0)))
    return joined.select(*rows.columns, *[both(n).alias(n) for n in totals])


def _stretch_parts(gap_ms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel over rows sorted by (ep, _st, s, e, idx): the merged parts of each stretch, as if nothing came before it."""

    def parts(t: pd.DataFrame) -> pd.DataFrame:
        t = t[~(t[["ep", "s", "e", "idx", "speaker"]].eq(t[["ep", "s", "e", "idx", "speaker"]].shift()).all(axis=1))]  # repeated rows
        new = (t["ep"] != t["ep"].shift()) | (t["_st"] != t["_st"].shift())
        run = (new | (t["speaker"] != t["speaker"].shift())).cumsum()
        reach = t["e"].groupby(run).cummax().shift().where(run == run.shift())
        part = (reach.isna() | (t["s"] - reach >= gap_ms)).cumsum()
        group, first = new.cumsum(), run.groupby(new.cumsum()).transform("min")
        got = t.assign(_part=part, _group=group, _first=run == first)
        out = got.groupby("_part", sort=False).agg(
            ep=("ep", "first"), _st=("_st", "first"), _group=("_group", "first"), _first=("_first", "first"), s=("s", "first"),
            e=("e", "max"), speaker=("speaker", "first"), n_rows=("idx", "size"), idx=("idx", "first"),
        )
        return out.assign(_edge=out["_first"] | (out["_group"] != out["_group"].shift(-1)), _part=np.arange(len(out)))

    def batch(t: pd.DataFrame) -> pa.RecordBatch:
        out = parts(t)[[n for n, _ in _PART]]
        return pa.RecordBatch.from_pandas(out, schema=pa.schema(_PART), preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        for b in batches:
            t = b.to_pandas() if held is None else pd.concat([held, b.to_pandas()], ignore_index=True)
            if not len(t):
                continue
            same = ((t["ep"] == t["ep"].iloc[-1]) & (t["_st"] == t["_st"].iloc[-1])).to_numpy()
            done = int(same.argmax())  # the last stretch may go on in the next batch
            if done:
                yield batch(t.iloc[:done])
            held = t.iloc[done:]
        if held is not None and len(held):
            yield batch(held)

    return run


_PART = [
    ("ep", pa.int64()), ("_st", pa.int64()), ("_part", pa.int64()), ("_first", pa.bool_()), ("_edge", pa.bool_()), ("s", pa.int64()),
    ("e", pa.int64()), ("speaker", pa.string()), ("n_rows", pa.int64()), ("idx", pa.int64()),
]


def merge_segments(segs: DataFrame, gap_ms: int = 300, stretch_ms: int = 600_000) -> DataFrame:
    """Merge segments (ep, idx, s, e, speaker) with the merged one before them if the speaker is the same
    and the gap is below gap_ms; returns ep, s, e, speaker, n_rows and idx, the first row's.

    Order is start, end, idx; repeated rows count once; rows with a null ep, time or speaker are left out. A
    run of one speaker is an island by itself; within it a segment opens a new island when it starts gap_ms
    or more after the furthest end so far. One pass over stretches of time merges each of them as if
    nothing came before it. Only parts of a stretch's first run, which an open run may reach into, and its last
    part meet again in a window of the episode, so the raw rows of an episode are spread over many tasks.
    """
    rows = segs.select(F.col("ep").cast("bigint"), F.expr(f"s div {stretch_ms}").alias("_st"), "s", "e", F.col("idx").cast("bigint"), "speaker").dropna()
    sorted_rows = rows.repartition("ep", "_st").sortWithinPartitions("ep", "_st", "s", "e", "idx", "speaker")
    parts = sorted_rows.mapInArrow(
        _stretch_parts(gap_ms), "ep bigint, _st bigint, _part bigint, _first boolean, _edge boolean, s bigint, e bigint, speaker string, n_rows bigint, idx bigint"
    )
    placed = parts.withColumn("_place", F.when(F.col("_edge"), F.lit(-1)).otherwise(F.col("_st")))
    order = ["_st", "s", "e", "idx"]
    w = Window.partitionBy("ep", "_place").orderBy(*order)
    # a part of a first run goes on with the run of the part before it if the speaker is the same
    on = F.col("_first") & F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    runs = placed.withColumn("_on", on)
    runs = runs.withColumn("_chain", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w.rowsBetween(UNBOUNDED, 0)))
    c = Window.partitionBy("ep", "_place", "_chain").orderBy(*order)
    reach = F.max("e").over(c.rowsBetween(UNBOUNDED, -1))
    cut = runs.withColumn("_opens", F.coalesce(F.col("s") - reach >= gap_ms, F.lit(True)))
    whole = cut.withColumn("_whole", F.sum(F.col("_opens").cast("int")).over(c.rowsBetween(UNBOUNDED, 0)))
    return (
        whole.groupBy("ep", "_place", "_chain", "_whole")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("speaker").alias("speaker"), F.sum("n_rows").alias("n_rows"), F.min_by("idx", F.struct(*order)).alias("idx"))
        .select(*[F.col(c).cast(segs.schema[c].dataType).alias(c) for c in ("ep", "s", "e", "speaker")], "n_rows", F.col("idx").cast(segs.schema["idx"].dataType))
    )


def collapsed_runs(words: DataFrame, most: int = 8) -> DataFrame:
    """Runs (ep, phrase, at, n_words) of more than `most` zero-length words in a row at one start.

    `words` has ep, phrase, word_no, s, e; runs don't cross phrases.
    """
    w = Window.partitionBy("ep", "phrase").orderBy("word_no")
    flat = F.col("e") == F.col("s")
    marked = words.withColumn("_flat", flat).withColumn("_olds", F.lag("s").over(w)).withColumn("_oldf", F.lag("_flat").over(w))
    numbered = islands(marked, ["ep", "phrase"], ["word_no"], ~F.col("_flat") | (F.col("s") != F.col("_olds")) | ~F.col("_oldf"), "_run")
    found = numbered.where("_flat").groupBy("ep", "phrase", "_run").agg(F.min("s").alias("at"), F.count("*").alias("n_words"))
    return found.where(F.col("n_words") > most).drop("_run")


def coalesce_turns(units: DataFrame, gap_ms: int = 2500) -> DataFrame:
    """Number the turns of units (ep, idx, s, e, speaker): one speaker, gaps to the last unit's end up to gap_ms."""
    old = neighbour(units, ["idx"], {"_sp": "speaker", "_e": "e", "_some": "idx"}, BLOCK_ROWS, ahead=False)
    cut = F.col("_some").isNull() | ~F.col("speaker").eqNullSafe(F.col("_sp")) | F.coalesce(F.col("s") - F.col("_e") > gap_ms, F.lit(True))
    numbered = running(old, ["idx"], {"turn_id": cut.cast("bigint")})
    return numbered.withColumn("turn_id", F.col("turn_id") - 1).drop("_sp", "_e", "_some")


def logical_turns(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Turns (ep, run, turn_id, speaker, s, e, n_chunks, reappears, mixed) of chunks (ep, turn_id, speaker, s, e and order).

    A turn is a longest sequence of consecutive chunks of one turn_id. `reappears` marks a turn whose id had a
    turn before it, `mixed` one with several speakers; both are errors of the stage that made the chunks
    (see `require_logical`).
    """
    w = Window.partitionBy("ep").orderBy(*order)
    new = ~F.col("turn_id").eqNullSafe(F.lag("turn_id").over(w))
    runs = islands(chunks.withColumn("_new", new), ["ep"], order, F.col("_new"), "run")
    first = F.struct(*order)
    turns = runs.groupBy("ep", "run").agg(
        F.first("turn_id").alias("turn_id"), F.min_by("speaker", first).alias("speaker"), F.min_by("s", first).alias("s"), F.max("e").alias("e"), F.count("*").alias("n_chunks"),
        (F.count_distinct(F.coalesce(F.col("speaker"), F.lit("\0"))) > 1).alias("mixed"),
    )
    again = F.row_number().over(Window.partitionBy("ep", "turn_id").orderBy("run")) > 1
    return turns.withColumn("reappears", again)


def require_logical(turns: DataFrame, stage: str) -> None:
    """Raise RuntimeError for turns of `logical_turns` that reappear or mix speakers."""
    what = F.concat(F.lit("turn "), F.col("turn_id").cast("string"), F.when(F.col("reappears"), " reappears after a different turn").otherwise(" contains multiple speakers"))
    require_none(turns.where("reappears OR mixed"), what, stage)


def true_runs(mask: DataFrame, keys: list[str], frame: str, flag: Column) -> DataFrame:
    """Maximal runs (keys, first_frame, last_frame, length) of consecutive frames where `flag` holds."""
    w = Window.partitionBy(*keys).orderBy(frame)
    on = mask.where(flag).withColumn("_g", F.col(frame) - F.row_number().over(w))
    return on.groupBy(*keys, "_g").agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("length")).drop("_g")


def dilate(mask: DataFrame, keys: list[str], frame: str, flag: str, k: int, name: str) -> DataFrame:
    """Add `name`: whether `flag` holds within k frames to either side; frames must be dense."""
    w = Window.partitionBy(*keys).orderBy(frame).rowsBetween(-k, k)
    return mask.withColumn(name, F.max(flag).over(w))


def preceding_context(rows: DataFrame, text: str, n: int = 3, name: str = "context", block: int = BLOCK_ROWS) -> DataFrame:
    """Add the texts of up to n rows before, joined by blanks; '' at the start. Null texts are skipped.

    Rows are worked in blocks of idx; the first and last n rows of the blocks meet in one window.
    """
    w = Window.partitionBy("ep", "_b").orderBy("idx")
    near = _blocks(rows, ["idx"], block).withColumn("_k", F.row_number().over(w)).withColumn("_left", F.count("*").over(Window.partitionBy("ep", "_b")) - F.col("_k"))
    near = near.withColumn("_near", F.collect_list(text).over(w.rowsBetween(-n, -1)))
    placed = near.withColumn("_place", F.when((F.col("_k") <= n) | (F.col("_left") < n), F.lit(-1)).otherwise(F.col("_b")))
    v = Window.partitionBy("ep", "_place").orderBy("idx").rowsBetween(-n, -1)
    far = F.when(F.col("_k") <= n, F.collect_list(text).over(v)).otherwise(F.col("_near"))
    return placed.withColumn(name, F.concat_ws(" ", far)).select(*[c for c in rows.columns if c != name], name)


def max_plus_starts(turns: DataFrame, gap_ms: int = 250, early_ms: int = 1500) -> DataFrame:
    """Start of each turn (ep, idx, cue, dur) when it follows the one before by gap_ms, at most early_ms early.

    start_i = max(start_{i-1} + dur_{i-1} + gap, cue_i - early), the first at its cue: a prefix maximum
    after the summed durations are taken off, so two prefix passes replace the sequential rule.
    """
    summed = running(turns, ["idx"], {"_sum": F.col("dur") + gap_ms, "_no": F.lit(1).cast("bigint")})
    before = F.col("_sum") - F.col("dur") - gap_ms
    base = F.when(F.col("_no") == 1, F.col("cue")).otherwise(F.col("cue") - early_ms)
    far = running(summed.withColumn("_before", before), ["idx"], {"_rel": base - before}, most=True)
    return far.withColumn("start", F.col("_rel") + F.col("_before")).drop("_sum", "_no", "_before", "_rel")
