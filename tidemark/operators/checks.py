"""Constraint checks on records, and joins that audit one table against another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def span_violations(rows: DataFrame, positive: bool = True) -> Column:
    """Array of what is wrong with a row's start_s and end_s: missing, not_finite, negative, order."""
    s, e = F.col("start_s"), F.col("end_s")
    missing = s.isNull() | e.isNull()
    big = F.lit(float("inf"))
    odd = F.isnan(s) | F.isnan(e) | (F.abs(s) == big) | (F.abs(e) == big)
    order = (e <= s) if positive else (e < s)
    found = F.array(
        F.when(missing, "missing"),
        F.when(~missing & odd, "not_finite"),
        F.when(~missing & ~odd & (s < 0), "negative"),
        F.when(~missing & ~odd & order, "order"),
    )
    return F.array_compact(found)


def words_out_of_order(words: Column, start: Column, end: Column, tolerance: float = 0.001) -> Column:
    """Whether a phrase's words go back in time or leave its span by more than the tolerance."""
    back = F.exists(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.get(words, i)["start_s"] < F.get(words, i - 1)["start_s"])
    outside = F.exists(words, lambda w: (w["start_s"] < start - tolerance) | (w["end_s"] > end + tolerance))
    return F.coalesce(back, F.lit(False)) | F.coalesce(outside, F.lit(False))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def missing_keys(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are not present."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def missing_report(expected: DataFrame, present: DataFrame, group: str, key: str, shown: int = 10) -> DataFrame:
    """Groups with missing keys (group, n_missing, first): how many, and the first `shown` of them in order.

    Only the keys that can be shown are gathered: each group's missing keys are numbered first.
    """
    lost = missing_keys(expected, present, [group, key])
    ranked = lost.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    first = F.array_sort(F.collect_list(F.when(F.col("_k") <= shown, F.col(key))))
    return ranked.groupBy(group).agg(F.count("*").alias("n_missing"), first.alias("first"))


def blank_texts(rows: DataFrame, texts: list[str], least: int = 1) -> Column:
    """Array of the text columns that are null, blank or shorter than `least` characters without outer blanks."""
    bad = [F.when(F.coalesce(F.length(F.trim(F.col(t))) < least, F.lit(True)), F.lit(t)) for t in texts]
    return F.array_compact(F.array(*bad))


def strict_zip(left: DataFrame, right: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The rows of both tables with equal keys and position; a key whose two sides have different positions fails the job.

    Columns other than keys and position must differ. Both sides must have unique positions.
    """
    a, b = left.withColumn("_a", F.lit(True)), right.withColumn("_b", F.lit(True))
    both = a.join(b, [*keys, position], "full")
    odd = F.raise_error(F.concat_ws(" ", F.lit("one side lacks position"), F.col(position).cast("string"), F.lit("of"), *[F.col(k).cast("string") for k in keys]))
    return both.where(F.when(F.col("_a") & F.col("_b"), F.lit(True)).otherwise(odd.cast("boolean"))).drop("_a", "_b")


def require_none(failures: DataFrame, told: Column, what: str, shown: int = 10) -> None:
    """Raise RuntimeError if there are failures, with at most `shown` of them: a gate between stages."""
    found = [r[0] for r in failures.select(told.cast("string")).limit(shown + 1).collect()]  # bounded
    if found:
        raise RuntimeError(f"{what}: " + ", ".join(found[:shown]) + (", ..." if len(found) > shown else ""))


def set_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of the two tables has, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def digest_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Paths whose content (binaryFile rows: path, content) has another SHA-256 than expected (path, sha256)."""
    return files.select("path", F.sha2("content", 256).alias("actual")).join(expected, "path").where("actual <> sha256")


# --- fixed values: keys of model settings that name code to be run
UNSAFE_KEYS = ("_attn_implementation_internal", "_experts_implementation_internal", "auto_map", "trust_remote_code")


def unsafe_fields(rows: DataFrame, text: str, keys: list[str], names: tuple[str, ...] = UNSAFE_KEYS) -> DataFrame:
    """Paths (keys, path) of the named fields in JSON texts at any depth; nothing below a hit is searched.

    Texts that are no JSON give one row with the path '!'.
    """
    wanted = frozenset(names)

    def walk(node: object, path: str) -> Iterator[str]:
        if isinstance(node, dict):
            for k, v in node.items():
                here = f"{path}.{k}" if path else k
                if k in wanted:
                    yield here
                else:
                    yield from walk(v, here)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(v, f"{path}[{i}]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            at, found = [], []
            for r, t in enumerate(pdf[text]):
                try:
                    paths = list(walk(json.loads(t), "")) if t else []
                except (ValueError, RecursionError):
                    paths = ["!"]
                at.extend([r] * len(paths))
                found.extend(paths)
            yield pdf[keys].iloc[at].assign(path=pd.Series(found, dtype=object).to_numpy())

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    return rows.select(*keys, text).mapInPandas(run, schema + ", path string")


def require_safe_settings(spark: SparkSession, folder: str, name: str = "config.json") -> int:
    """The number of settings files under a folder; RuntimeError where there is none, one is no JSON, or one names code."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(folder)
    texts = found.select("path", F.decode("content", "UTF-8").alias("body"))
    n = texts.count()
    if not n:
        raise RuntimeError(f"no {name} under {folder}")
    bad = unsafe_fields(texts.select(F.col("path").alias("file"), "body"), "body", ["file"])
    told = F.when(F.col("path") == "!", F.concat(F.col("file"), F.lit(" is no JSON"))).otherwise(F.concat_ws(" in ", "path", "file"))
    require_none(bad, told, "unsafe settings")
    return n
