"""Stage artifacts: versioned envelopes, cache probes, key-value caches and the event log, as Spark sources.

An artifact is a folder with `payload` (parquet rows) and `envelope` (one JSON row: schema_version, stage,
provenance). Spark's committers make each write atomic; the envelope is written last, so a reader never
takes a half-written payload for an artifact.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ArtifactError(RuntimeError):
    """A missing, unreadable or invalid artifact."""


@dataclass(frozen=True)
class Spec:
    """Stage name, version and row schema of an artifact."""

    stage: str
    schema: StructType
    version: int = 1


_WORD = "struct<text:string,start:double,end:double>"
#: Artifacts of the stages: (name, stage, schema of the rows).
_STAGE_ROWS = (
    ("phrases", "asr", f"start double, end double, text string, words array<{_WORD}>"),
    ("diarization_segments", "diarize", "start double, end double, speaker string"),
    ("speaker_phrases", "diarize", f"start double, end double, text string, words array<{_WORD}>, speaker string"),
    ("speaker_references", "refs", "speaker string, audio_file string, duration_s double, transcript string"),
    ("translation_units", "translate", f"start double, end double, speaker string, source_text string, target_text string, words array<{_WORD}>"),
    ("turn_chunks", "tts", "start double, end double, speaker string, text string, source_text string, turn_id int, part_index int, audio_file string, audio_duration_s double, audio_sha256 string"),
    ("placement_result", "place", "output_file string, duration_s double, n_turns int"),
)


def stage_specs() -> dict[str, Spec]:
    """The specs of the stages' artifacts by name; needs a Spark session."""
    return {name: Spec(stage, StructType.fromDDL(schema)) for name, stage, schema in _STAGE_ROWS}


def write_text_atomic(path: str | os.PathLike[str], text: str) -> None:
    """Write a text beside its place and rename it there, so that no reader sees half of it."""
    place = Path(path)
    place.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=place.parent, prefix=place.name, suffix=".tmp", delete=False) as f:
        f.write(text)
    try:
        os.replace(f.name, place)
    except OSError:
        os.unlink(f.name)
        raise


def write_document(path: str | os.PathLike[str], spec: Spec, provenance: dict, rows: list[dict]) -> None:
    """A small artifact as one canonical JSON document: sorted keys, two blanks of indent, a line feed at the end.

    Rows must have the fields of the spec and no others.
    """
    names = set(spec.schema.names)
    for i, r in enumerate(rows):
        if set(r) != names:
            raise ArtifactError(f"{path}: row {i} has not the fields of {spec.stage}")
    body = {"schema_version": spec.version, "stage": spec.stage, "provenance": provenance, "payload": rows}
    write_text_atomic(path, json.dumps(body, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def read_document(path: str | os.PathLike[str], spec: Spec) -> tuple[dict, list[dict]]:
    """(provenance, rows) of a JSON document; a missing, broken or foreign one raises ArtifactError."""
    try:
        body = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise ArtifactError(f"{path}: missing") from e
    except (OSError, ValueError) as e:
        raise ArtifactError(f"{path}: no JSON: {e}") from e
    if not isinstance(body, dict) or (body.get("schema_version"), body.get("stage")) != (spec.version, spec.stage):
        raise ArtifactError(f"{path}: not {spec.stage} version {spec.version}")
    if not isinstance(body.get("payload"), list) or any(set(r) != set(spec.schema.names) for r in body["payload"]):
        raise ArtifactError(f"{path}: rows have another schema")
    return body.get("provenance", {}), body["payload"]


def provenance_digest(provenance: dict) -> str:
    """SHA-256 of a provenance as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(provenance, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_artifact(df: DataFrame, path: str, spec: Spec, provenance: dict) -> None:
    """Write rows under the spec's schema, then their envelope."""
    spark = df.sparkSession
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields]
    df.select(*cols).write.mode("overwrite").parquet(f"{path}/payload")
    head = [(spec.version, spec.stage, provenance_digest(provenance), json.dumps(provenance, sort_keys=True, ensure_ascii=False))]
    spark.createDataFrame(head, _ENVELOPE).coalesce(1).write.mode("overwrite").json(f"{path}/envelope")


_ENVELOPE = "schema_version int, stage string, provenance_digest string, provenance string"


def read_artifact(spark: SparkSession, path: str, spec: Spec) -> DataFrame:
    """Rows of an artifact; missing, corrupt, foreign or differently shaped ones raise ArtifactError."""
    if not _exists(spark, f"{path}/envelope/_SUCCESS"):
        raise ArtifactError(f"{path}: missing")
    try:
        head = spark.read.schema(_ENVELOPE).option("mode", "FAILFAST").json(f"{path}/envelope").first()
    except Exception as e:
        raise ArtifactError(f"{path}: envelope can't be read: {e}") from e
    if head is None or head["stage"] != spec.stage or head["schema_version"] != spec.version:
        raise ArtifactError(f"{path}: not {spec.stage} version {spec.version}")
    rows = spark.read.parquet(f"{path}/payload")
    shape = lambda s: [(f.name, f.dataType) for f in s.fields]
    if shape(rows.schema) != shape(spec.schema):
        raise ArtifactError(f"{path}: rows have another schema")
    return rows


def load_cached(spark: SparkSession, path: str, spec: Spec, provenance: dict) -> DataFrame | None:
    """Rows of an artifact made from exactly this provenance; None for a miss or another version."""
    if not _exists(spark, f"{path}/envelope/_SUCCESS"):
        return None
    head = spark.read.schema(_ENVELOPE).option("mode", "FAILFAST").json(f"{path}/envelope").first()
    if head is None or head["schema_version"] != spec.version or head["provenance_digest"] != provenance_digest(provenance):
        return None
    return read_artifact(spark, path, spec)


def materialise(df: DataFrame, path: str, spec: Spec, provenance: dict) -> DataFrame:
    """The cached rows, or these rows written and read again."""
    hit = load_cached(df.sparkSession, path, spec, provenance)
    if hit is not None:
        return hit
    write_artifact(df, path, spec, provenance)
    return read_artifact(df.sparkSession, path, spec)


# --- key-value caches


def cached_or_todo(keys: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, todo) of wanted keys against a cache table; `unique_cache` checks its keys."""
    return keys.join(cache, key), keys.join(cache.select(key), key, "left_anti")


def unique_cache(cache: DataFrame, key: str = "key") -> DataFrame:
    """The cache; a key that occurs twice fails the job."""
    twice = F.raise_error(F.concat_ws(" ", F.lit("the cache holds twice:"), F.col(key).cast("string")))
    grouped = cache.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in cache.columns if c != key])
    return grouped.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(twice.cast("boolean"))).select(*cache.columns)


def write_batches(rows: DataFrame, path: str, batch: str = "batch_index") -> None:
    """Add finished batches, a folder for each; a batch written again replaces its folder and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def batches_todo(wanted: DataFrame, spark: SparkSession, path: str, batch: str = "batch_index") -> DataFrame:
    """Wanted rows whose batch hasn't been written yet."""
    if not _exists(spark, path):
        return wanted
    return wanted.join(spark.read.parquet(path).select(batch).distinct(), batch, "left_anti")


def merged_batches(batches: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """Rows of all batches; a key in two batches or an expected key in none fails the job."""
    n = batches.groupBy(key).agg(F.count_distinct("batch_index").alias("_n"))
    known = expected.select(key).distinct().join(n, key, "full")
    bad = F.when(F.col("_n").isNull(), F.concat(F.lit("missing: "), F.col(key).cast("string"))).when(F.col("_n") > 1, F.concat(F.lit("in two batches: "), F.col(key).cast("string")))
    good = known.where(F.when(bad.isNull(), F.lit(True)).otherwise(F.raise_error(bad).cast("boolean"))).select(key)
    return batches.join(good, key)


# --- event log

EVENTS = (
    "kind string, timestamp_s double, batch_index int, ids array<int>, model string,"
    " lines array<struct<id:int,source_text:string,target_text:string>>, turn string, speaker string, before string, after string,"
    " budget_words int, words_before int, words_after int, duration_before_s double, duration_after_s double, window_s double, ratio double, attempt int"
)


def event_faults(events: DataFrame) -> Column:
    """Array of what is wrong with an event of the log, by its kind: translate, rewrite_tighter or rewrite_fuller."""
    have = set(events.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None)
    fault = lambda bad, what: F.when(F.coalesce(bad, F.lit(True)), F.lit(what))
    moved, told = F.col("kind") == "translate", F.col("kind").isin("rewrite_tighter", "rewrite_fuller")
    lines = F.transform(col("lines"), lambda x: x["id"]) if "lines" in have else F.lit(None)
    short = F.exists(col("lines"), lambda x: ~(F.length(x["source_text"]) > 0) | ~(F.length(x["target_text"]) > 0) | ~(x["id"] >= 0)) if "lines" in have else F.lit(True)
    found = [
        F.when(~F.coalesce(moved | told, F.lit(False)), "kind"),
        fault(~(col("timestamp_s") > 0), "timestamp_s"),
        fault(~(F.length(col("model")) > 0), "model"),
        F.when(moved, fault(~(col("batch_index") >= 0), "batch_index")),
        F.when(moved, fault(F.size(F.array_distinct(col("ids"))) != F.size(col("ids")), "ids")) if "ids" in have else F.when(moved, "ids"),
        F.when(moved, fault(~lines.eqNullSafe(col("ids")) if "lines" in have and "ids" in have else F.lit(True), "lines")),
        F.when(moved, fault(short, "line")),
        *[F.when(told, fault(~(F.length(col(n)) > 0), n)) for n in ("turn", "speaker", "before", "after")],
        *[F.when(told, fault(~(col(n) > 0), n)) for n in ("budget_words", "words_before", "words_after", "duration_before_s", "duration_after_s", "window_s", "ratio")],
        F.when(told, fault(~(col("attempt") >= 0), "attempt")),
    ]
    return F.array_compact(F.array(*found))


def append_events(df: DataFrame, path: str) -> None:
    """Append checked events as JSON lines; a job adds files and rewrites none. A faulty event fails the job."""
    faults = event_faults(df)
    bad = F.raise_error(F.concat_ws(" ", F.lit("faulty event:"), F.concat_ws(", ", faults))).cast("boolean")
    df.where(F.when(F.size(faults) == 0, F.lit(True)).otherwise(bad)).write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log under the fixed schema; a malformed line fails the read with its file and its text."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where("length(trim(value)) > 0")
    parsed = lines.select("value", "_file", F.from_json("value", EVENTS + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("v"))
    broken = F.col("v").isNull() | F.col("v._bad").isNotNull() | F.col("v.kind").isNull()
    fail = F.raise_error(F.concat(F.lit("malformed event in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 200))).cast("boolean")
    good = parsed.where(F.when(broken, fail).otherwise(F.lit(True)))
    return good.select("v.*").drop("_bad")
