"""Queries of the text operators over the project's tables; their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunking import least_length, split_oversized
from tidemark.llm.counts import fit_models, labelled
from tidemark.llm.langid import Fit, identify, label_defects, training_texts
from tidemark.llm.leakage import find_leaks
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pairs import find_defects
from tidemark.llm.ppm import ByteModels
from tidemark.llm.sentences import split_sentences
from tidemark.llm.turns import cast_of, clean_rows, fit_model, speaker_turns
from tidemark.session import cut_lineage, small, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def job_langs(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(ep, lang) of the jobs, one row an episode."""
    return table(spark, sf_dir, "jobs").select("ep", F.lower(F.trim(column)).alias("lang")).where("ep is not null").dropDuplicates(["ep"])


def logged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ep, idx, line_id, source_text, target_text) of the logged translation lines."""
    events = spread(table(spark, sf_dir, "translate_events").select("ep", "idx", "pairs"), "ep", "idx")
    events = events.select("ep", "idx", F.explode("pairs").alias("p"))
    return events.select("ep", "idx", F.col("p.id").alias("line_id"), "p.source_text", "p.target_text")


#: Bounds of a sample for the pairs, for tests; p1_found fits on all rows.
PAIR_FIT = Fit(bytes_each=120_000)


def pair_samples(spark: SparkSession, sf_dir: str, fit: Fit = PAIR_FIT) -> dict[str, list[bytes]]:
    """The sample of phrases, units and the sources of an episode's first fit.batches log batches, whose words only the log has."""
    units = table(spark, sf_dir, "translation_units")
    sources = logged_pairs(spark, sf_dir).where(F.col("idx") < fit.batches).select("ep", F.col("line_id").alias("idx"), "source_text")
    texts = [(table(spark, sf_dir, "phrases"), "text", "source_lang"), (units, "target_text", "target_lang"), (sources, "source_text", "source_lang")]
    return training_texts(table(spark, sf_dir, "jobs"), texts, fit)


def pair_texts(spark: SparkSession, sf_dir: str, langs: DataFrame, logged: DataFrame) -> DataFrame:
    """(lang, text) of all phrases, units and logged sources, whose languages `langs` has by episode."""
    phrases, units = (spread(table(spark, sf_dir, t).select("ep", "idx", c), "ep", "idx") for t, c in (("phrases", "text"), ("translation_units", "target_text")))
    return labelled(langs, [(phrases, "text", "source_lang"), (units, "target_text", "target_lang"), (logged, "source_text", "source_lang")])


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective logged lines with the type of their defect."""
    jobs = table(spark, sf_dir, "jobs")
    logged = logged_pairs(spark, sf_dir)
    # read for each of the three tables of texts and for the pairs
    langs = small(cut_lineage(jobs.groupBy("ep").agg(*[F.first(F.lower(F.trim(c)), ignorenulls=True).alias(c) for c in ("source_lang", "target_lang")])))
    models = fit_models(pair_texts(spark, sf_dir, langs, logged))
    known = logged.join(langs, "ep", "left")
    return find_defects(known, models, ["ep", "idx", "line_id"]).distinct()


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the ASR phrases and of the translated units."""
    found = None
    for name, text in (("phrases", "text"), ("translation_units", "target_text")):
        part = split_sentences(spread(table(spark, sf_dir, name).select("ep", "idx", text), "ep", "idx"), text, ["ep", "idx"]).select(F.lit(name).alias("record_type"), "*")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "translation_units")
    found = None
    for field, column in (("source_text", "source_lang"), ("target_text", "target_lang")):
        # only long texts reach the join
        long = units.select("ep", "idx", F.col(field).alias("text")).where(F.length("text") >= least_length())
        with_lang = long.join(job_langs(spark, sf_dir, column), "ep", "left")
        part = split_oversized(with_lang, "text", F.col("lang"), ["ep", "idx"]).select("ep", "idx", F.lit(field).alias("field_name"), "piece_no", "char_start", "core_start", "char_end", "size", "overlap", "cut", "text_cut")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields over the limit and how their text had to be cut."""
    return p3_pieces(spark, sf_dir).where("piece_no = 0").select("ep", "idx", "field_name", F.col("text_cut").alias("cut"))


QUERIES["p3_pieces"] = p3_pieces


_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FIELDS = """f AS (SELECT DISTINCT u.ep, u.idx, 'source_text' AS field_name, u.source_text AS text, j.source_lang AS lang FROM translation_units u LEFT JOIN (SELECT ep, any_value(lower(trim(source_lang))) AS source_lang FROM jobs GROUP BY ep) j USING (ep)
  UNION SELECT u.ep, u.idx, 'target_text', u.target_text, j.target_lang FROM translation_units u LEFT JOIN (SELECT ep, any_value(lower(trim(target_lang))) AS target_lang FROM jobs GROUP BY ep) j USING (ep))"""
SQL["p3_sizes"] = f"""WITH {_FIELDS},
n AS (SELECT ep, idx, field_name, coalesce(lang IN ('ja', 'th', 'zh'), false) AS by_char, len(regexp_extract_all(text, '{_SPACE.replace('[', '[^', 1)}+')) AS words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS chars FROM f)
SELECT ep, idx, field_name, CAST(CASE WHEN by_char THEN chars ELSE words END AS BIGINT) AS size FROM n WHERE CASE WHEN by_char THEN chars > 700 ELSE words > 275 END"""


@query
def p3_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each oversized field, from its pieces: what they hold without their overlaps."""
    p = p3_pieces(spark, sf_dir)
    own = F.col("size") - F.when(F.col("piece_no") == 0, 0).otherwise(F.col("overlap"))
    return p.groupBy("ep", "idx", "field_name").agg(F.sum(own).alias("size"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of clean speech."""
    # read three times: for the sample's size, the sample and the rows
    cast = cut_lineage(cast_of(table(spark, sf_dir, "speaker_refs"), table(spark, sf_dir, "jobs")))
    transcript = table(spark, sf_dir, "speaker_phrases").select("ep", "idx", "start_s", "end_s", "text", "speaker")
    model = fit_model(transcript, cast)
    # only what the turns need goes into the shuffle
    spoken = clean_rows(spread(transcript, "ep", "idx"), small(cast), model).drop("clean")
    return speaker_turns(spoken).select("ep", "first_idx", "last_idx", "speaker", "n_letters")


#: Compatibility characters that the tables hold (full-width forms, a Thai vowel), for engines that know only NFC.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u0e33"
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + "\u0e32"
_STREAM = "regexp_replace(lower(nfc_normalize(translate(text, '%s', '%s'))), '[^\\p{L}\\p{N}]+', '', 'g')" % (_WIDE, _NARROW)
SQL["p6_found"] = f"""WITH i AS (SELECT item_id, CASE WHEN lang IN ('ja', 'ko', 'zh') THEN 40 ELSE 80 END AS n, {_STREAM} AS s FROM (SELECT DISTINCT item_id, text, lang FROM eval_items)),
d AS (SELECT doc_id, {_STREAM} AS s FROM (SELECT DISTINCT doc_id, text FROM documents)),
g AS (SELECT DISTINCT item_id, n, substr(s, k, n) AS piece FROM (SELECT *, unnest(range(1, length(s) - n + 2)) AS k FROM i WHERE length(s) >= n)),
p AS (SELECT doc_id, n, substr(s, k, n) AS piece FROM (SELECT doc_id, s, n, unnest(range(1, length(s) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE length(s) >= n))
SELECT DISTINCT doc_id, item_id FROM p JOIN g USING (n, piece)"""


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a stretch of a test item."""
    found = find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


@query
def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with their copies."""
    return mix_sources(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id"), table(spark, sf_dir, "mix_targets"))[0]


@query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def language_models(spark: SparkSession, sf_dir: str) -> ByteModels:
    """Byte models fitted on a bounded sample of phrases and units, whose languages the jobs state."""
    units = table(spark, sf_dir, "translation_units")
    texts = [(table(spark, sf_dir, "phrases"), "text", "source_lang"), (units, "source_text", "source_lang"), (units, "target_text", "target_lang")]
    return ByteModels.fit(training_texts(table(spark, sf_dir, "jobs"), texts), order=4)


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label, and the segments of mixed ones."""
    segments = identify(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id"), language_models(spark, sf_dir))
    return label_defects(segments).select("doc_id", "defect", "seg_no", "char_start", "lang")
