"""Continuous periods and gaps of overlapping intervals, by canonical dyadic blocks.

An interval [s, e) of integer milliseconds is a disjoint union of O(log) dyadic blocks [i*2^l, (i+1)*2^l).
Blocks of one key are nested or disjoint, so a block covered by an ancestor is found by one running
maximum; sibling pairs merge upward level by level, and adjacent blocks then join to periods.

Time is cut into cells of 2^20 ms and a key's cells are worked independently, so a key that holds a third
of all rows is spread over its timeline. Each cell yields its merged pieces; only the first and the last
piece of a cell can touch a neighbour, so only those meet again in one window per key.

The cells don't depend on the data. An interval of very many cells is cut along wider canonical blocks
(2^30, 2^40, 2^50 ms): what it covers of those stays one row a block, and pieces in cells under such a block are
dropped, so a single absurd row costs a few thousand rows and changes nothing for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 20
#: Widths of the blocks of very long intervals, beyond the cells; each holds 2^10 of the width before.
WIDE_BITS = (30, 40, 50)
#: Latest time in ms (some 285,000 years); what lies beyond counts as this.
LAST_MS = 1 << 53
#: Rows of one cell that are held before they are reduced to blocks.
HELD_ROWS = 1 << 18


def to_ms(seconds: Column) -> Column:
    """Milliseconds as BIGINT; null for null, NaN and infinities. Times beyond LAST_MS count as LAST_MS."""
    s = seconds.cast("double")
    far = F.lit(float(LAST_MS))
    finite = ~F.isnan(s) & (F.abs(s) < F.lit(float("inf")))
    return F.when(finite, F.greatest(-far, F.least(far, F.round(s * 1000)))).try_cast("bigint")


def _wide_parts(s: Column, e: Column) -> Column:
    """Array of (bits, a, b): the ranges of cells (bits 20) and wide blocks that tile [s, e), cells at its borders included."""

    def ranges(lo: Column, hi: Column, bits: int, wider: tuple[int, ...]) -> list[Column]:
        """Ranges of blocks of 2^bits ms from block lo to before block hi."""
        one = lambda a, b: F.struct(F.lit(bits).alias("bits"), a.alias("a"), b.alias("b"))
        if not wider:
            return [one(lo, hi)]
        up = wider[0] - bits
        first, last = F.shiftright(lo + F.lit((1 << up) - 1), up), F.shiftright(hi, up)
        has = first < last
        head = one(lo, F.when(has, F.shiftleft(first, up)).otherwise(hi))
        tail = one(F.when(has, F.shiftleft(last, up)).otherwise(hi), hi)
        return [head, tail, *ranges(first, F.greatest(first, last), wider[0], wider[1:])]

    lo, hi = F.shiftright(s, CELL_BITS), F.shiftright(e - 1, CELL_BITS) + 1
    # the first and last cell may be covered in part: they stay cells
    inner = ranges(F.least(lo + 1, hi), F.greatest(F.least(lo + 1, hi), hi - 1), CELL_BITS, WIDE_BITS)
    border = [
        F.struct(F.lit(CELL_BITS).alias("bits"), lo.alias("a"), F.least(lo + 1, hi).alias("b")),
        F.struct(F.lit(CELL_BITS).alias("bits"), F.greatest(lo + 1, hi - 1).alias("a"), hi.alias("b")),
    ]
    return F.filter(F.array(*border, *inner), lambda x: x["a"] < x["b"])


def dyadic_blocks(gid: np.ndarray, s: np.ndarray, e: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical blocks of the intervals [s, e) inside groups: (start code, level); a code is gid * 2^bits + position."""
    diff = s ^ e
    # the highest differing bit splits the interval at a multiple of its power
    top = np.frexp(diff.astype(np.float64))[1].astype(np.int64) - 1
    mid = (e >> top) << top
    left, right = mid - s, e - mid
    base = gid << bits
    codes, levels = [], []
    for level in range(bits + 1):
        bit = np.int64(1) << level
        at = np.nonzero(left & bit)[0]
        if len(at):
            codes.append(base[at] + s[at] + (left[at] & (bit - 1)))
            levels.append(np.full(len(at), level, np.int8))
        at = np.nonzero(right & bit)[0]
        if len(at):
            codes.append(base[at] + mid[at] + ((right[at] >> (level + 1)) << (level + 1)))
            levels.append(np.full(len(at), level, np.int8))
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int8)
    return np.concatenate(codes), np.concatenate(levels)


def drop_covered(code: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks without a (proper or equal) ancestor among the others."""
    order = np.lexsort((-level, code))
    code, level = code[order], level[order]
    if not len(code):
        return code, level
    end = np.maximum.accumulate(code + (np.int64(1) << level.astype(np.int64)))
    keep = np.ones(len(code), bool)
    keep[1:] = end[:-1] <= code[1:]
    return code[keep], level[keep]


def merge_siblings(code: np.ndarray, level: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint blocks with every complete sibling pair replaced by its parent, bottom up."""
    codes, levels = [], []
    up = np.empty(0, np.int64)
    for lv in range(bits + 1):
        here = np.sort(np.concatenate([code[level == lv], up])) >> lv
        if lv < bits and len(here) > 1:
            low = np.nonzero((here[:-1] & 1 == 0) & (here[1:] == here[:-1] + 1))[0]
            up = here[low] << lv
            rest = np.ones(len(here), bool)
            rest[low] = rest[low + 1] = False
            here = here[rest]
        else:
            up = np.empty(0, np.int64)
        codes.append(here << lv)
        levels.append(np.full(len(here), lv, np.int8))
    return np.concatenate(codes), np.concatenate(levels)


def _reduce(gid: np.ndarray, s: np.ndarray, e: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged pieces (gid, s, e) of intervals inside groups, in order."""
    code, level = merge_siblings(*drop_covered(*dyadic_blocks(gid, s, e, bits)), bits)
    order = np.argsort(code)
    a = code[order]
    b = a + (np.int64(1) << level[order].astype(np.int64))
    g = a >> bits
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != b[:-1]) | (g[1:] != g[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(a)) - 1 if len(a) else first
    g = g[first]
    return g, a[first] - (g << bits), b[last] - (g << bits)


def _cell_pieces(keys: list[str], bits: int):
    """Kernel over rows sorted by (keys, cell): merged pieces of each cell with their place in it."""
    names = [*keys, "cell"]

    def codes_of(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in names:
            c = t.column(k).combine_chunks()
            if isinstance(c, pa.ChunkedArray):
                c = c.chunk(0)
            d = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= d[1:] != d[:-1]
        return np.cumsum(new) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(t: pa.Table, gid: np.ndarray) -> pa.Table:
            s, e = t.column("s").to_numpy(), t.column("e").to_numpy()
            firsts = np.searchsorted(gid, np.arange(gid[-1] + 1))
            most = 1 << min(20, 61 - bits)
            parts = []
            for g0 in range(0, int(gid[-1]) + 1, most):
                a = firsts[g0]
                b = firsts[g0 + most] if g0 + most < len(firsts) else len(gid)
                g, x, y = _reduce(gid[a:b] - g0, s[a:b], e[a:b], bits)
                parts.append((g + g0, x, y))
            g, x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
            base = t.select(names).take(pa.array(firsts[g]))
            return base.append_column("s", pa.array(x)).append_column("e", pa.array(y))

        def final(t: pa.Table, gid: np.ndarray) -> Iterator[pa.RecordBatch]:
            p = emit(t, gid)
            g = codes_of(p)
            x, y = p.column("s").to_numpy(), p.column("e").to_numpy()
            off = p.column("cell").to_numpy() << bits
            first = np.ones(len(g), bool)
            first[1:] = g[1:] != g[:-1]
            last = np.append(first[1:], True)
            prev = np.append(np.int64(0), (y + off)[:-1])
            out = p.select(keys)
            for n, v in (("s", pa.array(x + off)), ("e", pa.array(y + off)), ("prev_e", pa.array(prev, mask=first)), ("edge", pa.array(first | last)), ("cell", p.column("cell"))):
                out = out.append_column(n, v)
            yield from out.to_batches(max_chunksize=65536)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            gid = codes_of(t)
            done = int(np.searchsorted(gid, gid[-1]))
            if done:
                yield from final(t.slice(0, done).combine_chunks(), gid[:done])
            held = t.slice(done).combine_chunks()
            if held.num_rows > HELD_ROWS:  # one cell of very many rows: its union is enough
                held = emit(held, np.zeros(held.num_rows, np.int64)).cast(held.schema).combine_chunks()
        if held is not None and held.num_rows:
            yield from final(held, codes_of(held))

    return run


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Periods and gaps of the integer intervals [start, end) of each key.

    Returns keys, kind ('period' or 'gap'), start_ms, end_ms. Touching intervals join; a gap lies between
    two consecutive periods of a key. Rows with a null key, a null bound, a negative start or an end not
    after the start are left out; repeated rows change nothing; an empty table gives no rows. Keys may be
    of any type with an order. Key columns may be named like the result's own columns only if those are
    not kind, start_ms or end_ms.
    """
    clean = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(start).alias("s"), F.col(end).alias("e"))
    names = [f"_k{i}" for i in range(len(keys))]
    for n in names:
        clean = clean.where(F.col(n).isNotNull())
    clean = clean.where("s >= 0 AND e > s")
    bits = CELL_BITS
    # the few long intervals; a filter over the scan, without a shuffle
    wide = clean.where(F.col("e") - F.col("s") >= F.lit(1 << WIDE_BITS[0]))
    some_wide = wide.limit(1).count() > 0
    cell = clean.select(
        "*", F.explode(F.sequence(F.shiftright("s", bits), F.shiftright(F.col("e") - 1, bits))).alias("cell")
    )
    if some_wide:
        parts = wide.select("*", F.inline(_wide_parts(F.col("s"), F.col("e"))))
        short = cell.where(F.col("e") - F.col("s") < F.lit(1 << WIDE_BITS[0]))
        at = parts.where(F.col("bits") == bits).select(*names, "s", "e", F.explode(F.sequence("a", F.col("b") - 1)).alias("cell"))
        blocks = parts.where(F.col("bits") > bits).select(*names, "bits", F.explode(F.sequence("a", F.col("b") - 1)).alias("block")).distinct()
        cell = short.unionByName(at)
        for w in WIDE_BITS:  # cells under a block that is covered as a whole
            here = blocks.where(F.col("bits") == w).select(*[F.col(n).alias(f"{n}_b") for n in names], "block")
            under = F.shiftright("cell", w - bits) == F.col("block")
            for n in names:
                under = under & (F.col(n) == F.col(f"{n}_b"))
            cell = cell.join(here, under, "left_anti")
    base = F.shiftleft(F.col("cell"), bits)
    cell = cell.select(
        *names,
        "cell",
        (F.greatest("s", base) - base).alias("s"),
        (F.least(F.col("e"), base + F.lit(1 << bits)) - base).alias("e"),
    )
    # equal rows and shorter intervals of one start go before the sort
    cell = cell.repartition(*names, "cell").sortWithinPartitions(*names, "cell")
    types = {f.name: f.dataType.simpleString() for f in cell.schema.fields}
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", s bigint, e bigint, prev_e bigint, edge boolean, cell bigint"
    found = cell.mapInArrow(_cell_pieces(names, bits), schema)
    if some_wide:
        start = F.expr("shiftleft(block, bits)")
        found = found.unionByName(
            blocks.select(*names, start.alias("s"), (start + F.expr("shiftleft(1L, bits)")).alias("e"), F.lit(None).cast("bigint").alias("prev_e"), F.lit(True).alias("edge"), F.lit(-1).cast("bigint").alias("cell"))
        )

    # the pieces at a cell's edges meet in one window a key, all others are alone in their cell's
    place = F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("cell"))
    w = Window.partitionBy(*names, "place").orderBy("s")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    linked = (
        found.withColumn("place", place)
        .withColumn("before", before)
        .withColumn("joins", F.coalesce(F.col("before") >= F.col("s"), F.lit(False)) & F.col("edge"))
        .withColumn("gap_from", F.when(~F.col("joins"), F.coalesce("prev_e", F.when(F.col("edge"), F.col("before")))))
        .withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w))
    )
    merged = linked.groupBy(*names, "place", "island").agg(
        F.min("s").alias("a"), F.max("e").alias("b"), F.max("gap_from").alias("gap_from")
    )
    period = F.struct(F.lit("period").alias("kind"), F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("gap_from").alias("start_ms"), F.col("a").alias("end_ms"))
    rows = F.when(F.col("gap_from").isNull(), F.array(period)).otherwise(F.array(period, gap))
    return merged.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.inline(rows))


def speaking_periods(segments: DataFrame) -> DataFrame:
    """Periods and gaps of each speaker of diar_segments (ep, speaker, kind, start_ms, end_ms).

    Seconds are rounded to milliseconds first; times beyond LAST_MS count as LAST_MS. Rows without a speaker
    (null or blank) are left out.
    """
    named = segments.where("length(trim(speaker)) > 0").select(
        "ep", "speaker", to_ms(F.col("start_s")).alias("start_ms"), to_ms(F.col("end_s")).alias("end_ms")
    )
    return merge_intervals(named, ["ep", "speaker"])
