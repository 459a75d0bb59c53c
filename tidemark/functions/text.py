"""Column functions on text, budgets and times; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_SECOND = 2.5
MAX_CHUNK_S = 110
MAX_WORDS = 275


def word_count(text: Column) -> Column:
    """Words separated by Unicode white space; 0 for null and blank texts."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))), F.lit(0))


def word_budget(seconds: Column) -> Column:
    """Words that fit a span at the speaking rate, half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(seconds * WORDS_PER_SECOND).cast("int"))


def fit_reward(actual: Column, wanted: Column) -> Column:
    """1 for the wanted number of words, falling with the distance in units of 5 % of it; 0 for no words."""
    unit = F.greatest(F.lit(1.0), 0.05 * wanted)
    off = F.abs(actual - wanted) / unit
    return F.when(actual <= 0, 0.0).otherwise(1.0 / (1.0 + off * off))


def interpolated_budget(lower: Column, upper: Column, fraction: Column, floor: int = 1, ceiling: int = MAX_WORDS) -> Column:
    """Budget between a measured short and a long text, strictly inside them where there is room."""
    raw = F.bround(lower + fraction * (upper - lower)).cast("int")
    inside = F.when(upper - lower > 1, F.least(upper - 1, F.greatest(lower + 1, raw))).otherwise(raw)
    return F.least(F.lit(ceiling), F.greatest(F.lit(floor), inside))


def tighter_budget(words: Column, ratio: Column, floor: Column) -> Column:
    """Budget of a text that must shrink to the window's share of its duration, with 5 % to spare."""
    return F.greatest(floor, F.bround(words * ratio * 0.95).cast("int"))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of integer milliseconds."""
    whole = F.floor(ms / 1000)
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)), F.pmod(ms, F.lit(1000))
    )


def tempo_chain(ratio: Column) -> Column:
    """Chain of tempo filters for a ratio: factors of 2.0 while more than 2 is left, then the rest."""
    doubles = F.greatest(F.lit(0), F.ceil(F.log2(ratio) - 1e-12) - 1).cast("int")
    rest = ratio / F.pow(F.lit(2.0), doubles)
    return F.concat_ws(",", F.concat(F.array_repeat(F.lit("atempo=2.0"), doubles), F.array(F.format_string("atempo=%.5f", rest))))


def rewrite_key(namespace: Column, budget: Column, text: Column) -> Column:
    """Key of a cached rewrite: SHA-1 over namespace, budget and text, separated by NUL."""
    nul = F.lit("\0")
    return F.sha1(F.concat(namespace, nul, budget.cast("string"), nul, text))


def digest(*columns: Column) -> Column:
    """SHA-256 of a row's columns as JSON in the given order; nulls are written."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ends_sentence(text: Column) -> Column:
    """Whether a text ends with a sentence mark, closing quotes allowed."""
    return text.rlike("[.!?…。！？][\"'”’»)]*\\s*$")


def round3(seconds: Column) -> Column:
    """Three decimals, half to even on the exact binary value."""
    return F.call_function("format_number", seconds, F.lit("0.000")).cast("double")
