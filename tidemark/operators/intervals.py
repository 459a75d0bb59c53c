"""Interval joins on an equality key, by time buckets.

A plain range predicate compares all rows of a key. Here both sides are cut into buckets of time and joined
on key and bucket, so a long or hot key is spread over its timeline; a pair that shares several buckets is
kept only in the one where the later of its two starts lies.

Buckets come in two widths, the second 2^18 times the first (at 60 s some 500 years). A span that covers fewer than
2^18 narrow buckets has those, a longer one the wide ones, and a pair meets at the wider one of its two: a span of
10^12 ms costs some hundred rows, not millions, and the buckets of all other rows stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factor between the widths of buckets, and the number of widths.
WIDER, WIDTHS = 1 << 18, 2


def _bucketed(df: DataFrame, start: str, end: str, width: int, before: int, after: int, side: int) -> DataFrame:
    """Rows with the codes of their buckets, `_code1` or `_code2` by the side of the join.

    A span has a width of its own and, for spans of the other side that are wider than it, copies at all wider
    ones. Codes are made so that two copies never meet: a code is the bucket's number, the width, and 0 where
    both spans have this width as their own, 1 where only that of side 2 has, or 2 where only that of side 1 has.
    Null times have no codes.
    """
    lo, hi = F.col(start) - before, F.greatest(F.col(end) + after, F.col(start))
    own = F.lit(WIDTHS - 1)
    for k in reversed(range(WIDTHS - 1)):
        own = F.when(hi - lo < F.lit(width * WIDER ** (k + 1)), k).otherwise(own)
    none = F.array().cast("array<bigint>")
    step = 3 * WIDTHS

    def codes(k: int, kind: int) -> Column:
        at = lambda x: F.floor(x / (width * WIDER**k)) * step + 3 * k + kind
        return F.sequence(at(lo), at(hi), F.lit(step).cast("bigint"))

    lists = [F.when(own == k, codes(k, 0)).otherwise(none) for k in range(WIDTHS)]
    for k in range(1, WIDTHS):  # nothing is narrower than the first width
        lists += [F.when(own == k, codes(k, 3 - side)).when(own < k, codes(k, side)).otherwise(none)]
    known = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return known.select("*", F.explode(F.concat(*lists)).alias(f"_code{side}"))


def overlap_join(
    left: DataFrame, right: DataFrame, key: str, l_span: tuple[str, str], r_span: tuple[str, str], on: Column, width: int = 60_000, margin: int = 0
) -> DataFrame:
    """Pairs of one key whose spans, the left one widened by `margin`, share a bucket and satisfy `on`.

    Columns of the two sides must differ but for `key`. Times are integers. Null keys and null times match
    nothing.
    """
    a = _bucketed(left, *l_span, width, margin, margin, 1)
    b = _bucketed(right, *r_span, width, 0, 0, 2).withColumnRenamed(key, "_rkey")
    both = a.join(b, (F.col(key) == F.col("_rkey")) & (F.col("_code1") == F.col("_code2")) & on, "inner")
    later = F.greatest(F.col(l_span[0]) - margin, F.col(r_span[0]))
    step = 3 * WIDTHS
    at, here = F.floor(F.col("_code1") / step), F.floor(later / width)
    for k in range(1, WIDTHS):
        here = F.when(F.floor(F.pmod(F.col("_code1"), F.lit(step)) / 3) == k, F.floor(later / (width * WIDER**k))).otherwise(here)
    return both.where(here == at).drop("_rkey", "_code1", "_code2")
