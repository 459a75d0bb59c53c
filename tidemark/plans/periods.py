"""Speaking periods and gaps (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.periods import speaking_periods
from tidemark.plans.registry import query, table


@query("""
WITH x AS (
  SELECT ep, speaker, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e
  FROM diar_segments
  WHERE isfinite(start_s) AND isfinite(end_s) AND length(trim(speaker)) > 0),
v AS (SELECT DISTINCT ep, speaker, s, e FROM x WHERE s >= 0 AND e > s),
w AS (SELECT *, max(e) OVER (PARTITION BY ep, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM v),
i AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY ep, speaker ORDER BY s, e) AS g FROM w),
p AS (SELECT ep, speaker, min(s) AS a, max(e) AS b FROM i GROUP BY ep, speaker, g)
SELECT ep, speaker, 'period' AS kind, a AS start_ms, b AS end_ms FROM p
UNION ALL
SELECT ep, speaker, 'gap', pb, a FROM (SELECT *, lag(b) OVER (PARTITION BY ep, speaker ORDER BY a) AS pb FROM p) WHERE pb IS NOT NULL
""")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaking_periods(table(spark, sf_dir, "diar_segments"))
