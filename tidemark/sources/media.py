"""WAV files as a source and sink, media listings, and subtitle and report sinks."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import html_escape, srt_time
from tidemark.operators.islands import STRETCH_MS, running

PARTIAL = r"(?i)(\.(part|ytdl|temp|tmp)$|\.part-frag)"


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples from -1 to 1) of 16-bit PCM; channels are averaged."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        v = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
        return w.getframerate(), v.reshape(-1, w.getnchannels()).mean(1) if w.getnchannels() > 1 else v


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono PCM of samples from -1 to 1; values beyond are cut."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.nan_to_num(samples), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_wavs(spark: SparkSession, path: str, frame_ms: int = 25) -> DataFrame:
    """Frames (path, rate, frame, samples) of all WAV files under a path; a short last frame is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                rate, v = decode_wav(c)
                n = max(1, rate * frame_ms // 1000)
                parts = [v[i : i + n].tolist() for i in range(0, len(v), n)]
                yield pd.DataFrame({"path": p, "rate": rate, "frame": range(len(parts)), "samples": parts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, frame int, samples array<float>")


def wav_durations(spark: SparkSession, path: str) -> DataFrame:
    """Seconds (path, rate, duration_s) of all WAV files under a path, from their headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = []
            for c in pdf["content"]:
                with wave.open(io.BytesIO(c)) as w:
                    heads.append((w.getframerate(), w.getnframes() / w.getframerate()))
            yield pd.DataFrame({"path": pdf["path"], "rate": [h[0] for h in heads], "duration_s": [h[1] for h in heads]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, duration_s double")


def resample(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """The vector at another rate, by linear interpolation (without a filter before thinning)."""
    if rate == wanted or not len(samples):
        return samples.astype(np.float32)
    n = max(1, round(len(samples) * wanted / rate))
    return np.interp(np.arange(n) * rate / wanted, np.arange(len(samples)), samples).astype(np.float32)


def write_wavs(tracks: DataFrame, path: str, rate: int) -> DataFrame:
    """Write tracks (name, samples) as WAV files into a folder all executors share; returns name, path and sha256.

    A file is written beside its place and renamed, so a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import os
        import uuid

        os.makedirs(path, exist_ok=True)
        for pdf in batches:
            places, digests = [], []
            for name, v in zip(pdf["name"], pdf["samples"], strict=True):
                content = encode_wav(np.asarray(v, np.float32), rate)
                place = os.path.join(path, f"{name}.wav")
                part = f"{place}.{uuid.uuid4().hex}.tmp"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, place)
                places.append(place)
                digests.append(hashlib.sha256(content).hexdigest())
            yield pd.DataFrame({"name": pdf["name"], "path": places, "sha256": digests})

    return tracks.select("name", "samples").mapInPandas(run, "name string, path string, sha256 string")


def one_input(names: DataFrame, folder: str, column: str = "name") -> DataFrame:
    """The one complete input of each folder; a folder with several fails the job."""
    n = F.count("*").over(Window.partitionBy(folder))
    odd = F.raise_error(F.concat_ws(" ", F.lit("several inputs in"), F.col(folder).cast("string"))).cast("boolean")
    return complete_inputs(names, column).withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(odd)).drop("_n")


def complete_inputs(names: DataFrame, column: str = "name") -> DataFrame:
    """Listed files called input.* that are not partial downloads."""
    return names.where(F.col(column).startswith("input.") & ~F.col(column).rlike(PARTIAL))


def srt_rows(cues: DataFrame, start: str = "s", end: str = "e", text: str = "text", order: tuple[str, ...] = ("s", "turn_id", "part_index")) -> DataFrame:
    """Subtitle blocks (ep, seq, block) numbered from 1 in each episode; times in ms."""
    block = F.format_string("%d\n%s --> %s\n%s\n\n", F.col("seq"), srt_time(F.col(start)), srt_time(F.col(end)), F.col(text))
    # numbered in stretches of time, so that a long episode is no single task
    return running(cues, list(order), {"seq": F.lit(1).cast("bigint")}, STRETCH_MS).withColumn("seq", F.col("seq").cast("int")).select("ep", "seq", block.alias("block"))


def write_srt(blocks: DataFrame, path: str) -> None:
    """One folder of text an episode, in order."""
    text = blocks.repartition("ep").sortWithinPartitions("ep", "seq").select("ep", F.regexp_replace("block", r"\n$", "").alias("value"))
    text.write.mode("overwrite").partitionBy("ep").text(path)


def write_transcripts(rows: DataFrame, path: str) -> None:
    """One text a speaker of an episode (ep, speaker, transcript), in folders by episode and speaker."""
    out = rows.select("ep", "speaker", F.col("transcript").alias("value")).repartition("ep", "speaker")
    out.write.mode("overwrite").partitionBy("ep", "speaker").text(path)


def html_row(speaker: Column, colour: Column, text: Column) -> Column:
    """A report row with escaped text and the speaker's colour."""
    return F.concat(F.lit('<tr class="c'), colour.cast("string"), F.lit('"><td>'), html_escape(speaker), F.lit("</td><td>"), html_escape(text), F.lit("</td></tr>"))


def speaker_colours(rows: DataFrame, palette: int = 8) -> DataFrame:
    """(ep, speaker, colour): colours by order of first appearance, modulo the palette."""
    first = rows.groupBy("ep", "speaker").agg(F.min("idx").alias("_first"))
    return first.withColumn("colour", F.pmod(F.row_number().over(Window.partitionBy("ep").orderBy("_first", "speaker")) - 1, F.lit(palette))).drop("_first")


def write_report(rows: DataFrame, path: str) -> None:
    """One HTML document a episode of report rows (ep, idx, html), in order, as text folders by episode."""
    edge = lambda tag, k: rows.select("ep").distinct().select("ep", F.lit(k).alias("_part"), F.lit(0).alias("idx"), F.lit(tag).alias("value"))
    body = rows.select("ep", F.lit(1).alias("_part"), "idx", F.col("html").alias("value"))
    page = edge('<!doctype html><meta charset="utf-8"><table>', 0).unionByName(body).unionByName(edge("</table>", 2))
    page.repartition("ep").sortWithinPartitions("ep", "_part", "idx").select("ep", "value").write.mode("overwrite").partitionBy("ep").text(path)
