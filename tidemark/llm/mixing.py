"""Mixing sources to target weights.

Tokens are summed by source, repetition rates follow from the target shares, and each document is then
given floor(rate) times plus once more with the fraction as probability, drawn from a hash of its id, so
that a run can be repeated. Sources that don't occur can't be met; the shares of the others keep their
proportions. Without a wanted size the mixture is the largest in which every share is met under the caps;
with one, capped sources give what they have and the others fill the rest in proportion.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# --- fixed values: how the byte-level vocabulary splits a text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Mixture:
    """Size and seed of a mixture; total_tokens None takes the largest that meets all shares."""

    total_tokens: int | None = None
    seed: int = 17
    tokenizer: str = TOKENIZER
    pattern: str = PATTERN
    #: Most sources a target table may name; it is collected.
    most_targets: int = 10_000


def canonical(source: Column) -> Column:
    """One spelling of a source name: lower case, underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def with_token_counts(docs: DataFrame, text: str, mix: Mixture = Mixture()) -> DataFrame:
    """`docs` without `text`, and n_tokens: the tokens of the whole text, 0 for null and empty ones."""
    # the vocabulary file is read here and broadcast, as executors may not have it; it has under 2 MB
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(mix.tokenizer).read_bytes())
    pattern = mix.pattern
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield pdf.drop(columns=[text]).assign(n_tokens=pd.array(n, "int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint"
    return docs.mapInPandas(run, schema)


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None) -> dict[str, float]:
    """Repetition rate of each source that has tokens and a share."""
    use = {s: t for s, t in targets.items() if tokens.get(s, 0) > 0 and (t[0] or 0) > 0 and (t[1] or 0) > 0}
    if not use:
        return {}
    whole = sum(t[0] for t in use.values())
    most = {s: tokens[s] * t[1] for s, t in use.items()}
    if total is None:
        total = min(most[s] * whole / t[0] for s, t in use.items())
    got: dict[str, float] = {}
    open_ = dict(use)
    rest = float(min(total, sum(most.values())))
    while open_:
        share = sum(t[0] for t in open_.values())
        over = [s for s, t in open_.items() if rest * t[0] / share > most[s] * (1 + 1e-12)]
        if not over:
            got |= {s: rest * t[0] / share / tokens[s] for s, t in open_.items()}
            break
        for s in over:
            got[s] = float(open_.pop(s)[1])
            rest -= most[s]
    return {s: min(r, float(use[s][1])) for s, r in got.items()}


def mix_sources(docs: DataFrame, targets: DataFrame, mix: Mixture = Mixture()) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of documents (doc_id, text, source) and targets (source, target_share, max_repeats).

    The mixture has doc_id, source, copy_no (from 1) and n_tokens. The report has, for each source of
    either table, target_share, max_repeats, tokens_in, rate, tokens_out and actual_share. Documents
    without tokens, without a source or of a source without a target are not used; rows that repeat a
    doc_id count once. Empty tables give an empty mixture.
    """
    counted = with_token_counts(docs.select("doc_id", canonical(F.col("source")).alias("source"), "text"), "text", mix)
    # two passes follow over these narrow rows; the texts are read and tokenized once
    counted = cut_lineage(counted.dropDuplicates(["doc_id"]).where("n_tokens > 0 AND source IS NOT NULL"))
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens_in"))
    wanted = targets.select(canonical(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    _few(wanted, mix)
    rows = wanted.join(sums, "source", "left").collect()
    got = rates({r["source"]: r["tokens_in"] or 0 for r in rows}, {r["source"]: (r["target_share"], r["max_repeats"]) for r in rows}, mix.total_tokens)
    spark = docs.sparkSession
    rate = spark.createDataFrame(list(got.items()) or [("", 0.0)], "source string, rate double").where("rate > 0")
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(mix.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    mixture = (
        counted.join(F.broadcast(rate), "source")
        .withColumn("copies", copies)
        .where("copies > 0")
        .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")
    )
    out = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens_out"))
    # no more rows than targets, so one window may hold them
    out = out.withColumn("total", F.sum("tokens_out").over(Window.partitionBy(F.lit(0))))
    report = (
        sums.join(wanted, "source", "full")
        .join(F.broadcast(rate), "source", "left")
        .join(F.broadcast(out), "source", "left")  # no more sources than targets
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"),
            F.coalesce("rate", F.lit(0.0)).alias("rate"),
            F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"),
            F.coalesce(F.try_divide(F.col("tokens_out"), F.col("total")), F.lit(0.0)).alias("actual_share"),
        )
    )
    return mixture, report


def _few(targets: DataFrame, mix: Mixture) -> None:
    n = targets.count()
    if n > mix.most_targets:
        raise ValueError(f"{n} target sources; the limit is {mix.most_targets}")
