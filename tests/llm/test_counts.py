"""Models counted over all rows, against the same models fitted in memory, and what beyond any sample they know."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import counts as C
from tidemark.llm import pairs as P
from tidemark.llm.langid import plain, romanise
from tidemark.llm.ppm import ByteModels
from tidemark.llm.queries import QUERIES, job_langs, logged_pairs, pair_texts
from tidemark.llm.sentences import spans

EN, ES = "The host praised the first draft in the garden.", "El presentador elogió el primer borrador en el jardín."


def whole_samples(rows):
    out = {}
    for g, t in rows:
        for s, e in spans(t):
            out.setdefault(g, []).append(plain(t[s:e]))
            other = romanise(t[s:e], g)
            if other:
                out[g].append(plain(other))
    return out


@pytest.mark.parametrize(("entries", "chars"), [(C.MOST_ENTRIES, C.SLICE_CHARS), (500, 2_000)])
def test_counts_equal_a_fit_on_all_sentences(spark, sf, monkeypatch, entries, chars):
    monkeypatch.setattr(C, "MOST_ENTRIES", entries)
    monkeypatch.setattr(C, "SLICE_CHARS", chars)
    whole = lambda d: pair_texts(spark, d, job_langs(spark, d, "source_lang").toDF("ep", "source_lang").join(job_langs(spark, d, "target_lang").toDF("ep", "target_lang"), "ep"), logged_pairs(spark, d))
    texts = whole(sf).unionByName(whole("/root/testdata/sf0.01").where("lang = 'th'"))
    samples = whole_samples([(r["lang"], r["text"]) for r in texts.collect()])
    # so that rates and numbers are the same
    assert all(sum(map(len, s)) < P.FIT_BYTES for s in samples.values()) and len(samples) > 5 and "th" in samples
    want, want_bytes = P.Dictionaries.fit(samples), ByteModels.fit(samples, 4)
    got, got_bytes = C.fit_models(texts)
    assert got.langs == want.langs and got.floor == pytest.approx(want.floor) and got.length == pytest.approx(want.length)
    assert got.rows.keys() == want.rows.keys() and all(got.table[got.rows[w]].tolist() == pytest.approx(want.table[r].tolist()) for w, r in want.rows.items())
    assert got.closings == {g: pytest.approx(c) for g, c in want.closings.items()}
    assert got.ends == {g: {c: n for c, n in ends.items() if n[0] + n[2] >= 5} for g, ends in want.ends.items()}
    some = [t for s in samples.values() for t in s[:20]] + [b"", b"QQ\xff"]
    assert got_bytes.langs == want_bytes.langs and got_bytes.score(some).tolist() == [pytest.approx(x) for x in want_bytes.score(some).tolist()]


def tables(spark, path, phrases, units, events):
    spark.createDataFrame([(1, "EN ", "es")], "ep bigint, source_lang string, target_lang string").write.parquet(f"{path}/jobs.parquet")
    spark.createDataFrame(phrases, "ep bigint, idx int, text string").write.parquet(f"{path}/phrases.parquet")
    spark.createDataFrame(units, "ep bigint, idx int, target_text string").write.parquet(f"{path}/translation_units.parquet")
    spark.createDataFrame(events, "ep bigint, idx int, pairs array<struct<id: int, source_text: string, target_text: string>>").write.parquet(f"{path}/translate_events.parquet")


def test_late_and_long_rows_are_counted(spark, tmp_path):
    # late phrases, long units and late batches: a sample of first and short rows holds none of the words
    lines = [(1, 40 + i, [(i, EN, ES)]) for i in range(5)] + [(1, 90, [(7, EN, "The guest read the second chapter aloud.")])]
    tables(spark, tmp_path, [(1, 0, "Yes.")] + [(1, 30 + i, EN) for i in range(5)], [(1, 0, "Sí."), (1, 1, " ".join([ES] * 50))], lines)
    known, _ = C.fit_models(pair_texts(spark, str(tmp_path), spark.createDataFrame([(1, "en", "es")], "ep bigint, source_lang string, target_lang string"), logged_pairs(spark, str(tmp_path))))
    assert known.knows(P.words("draft"), "en").all() and known.knows(P.words("borrador"), "es").all()
    assert {tuple(r) for r in QUERIES["p1_found"](spark, str(tmp_path)).collect()} == {(1, 90, 7, "wrong_language")}


def test_without_labelled_texts(spark, tmp_path):
    tables(spark, tmp_path, [], [], [(2, 0, [(0, EN, None), (1, EN, ES)])])
    assert [tuple(r) for r in QUERIES["p1_found"](spark, str(tmp_path)).collect()] == [(2, 0, 0, "empty")]


def test_more_text_makes_no_words_of_names(spark):
    """Words known and code lengths of strange text don't drift with the rows."""
    few = [("en", EN)] * 40 + [("es", ES)] * 40
    once = spark.createDataFrame(few, "lang string, text string")
    many = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("k").unionByName(spark.createDataFrame([("en", "Tolubo Nanato left.")] * 4, "lang string, text string"))
    (a, bytes_a), (b, bytes_b) = C.fit_models(once), C.fit_models(many)
    assert a.rows.keys() == b.rows.keys() and "tolubo" not in b.rows
    strange = [b"the guest sang", b"zug nach bonn"]
    assert (bytes_b.score(strange) < bytes_a.score(strange) + 8 * 14).all()
    plain_fit = ByteModels.fit({g: [plain(t) for h, t in few if h == g] * 300 for g in ("en", "es")}, 4)
    assert (bytes_b.score(strange) < plain_fit.score(strange)).all()


def test_defects_by_models_of_all_rows(spark):
    from test_pairs import CASES, SF, test_planted_defects_are_found

    langs = job_langs(spark, SF, "source_lang").toDF("ep", "source_lang").join(job_langs(spark, SF, "target_lang").toDF("ep", "target_lang"), "ep")
    models = C.fit_models(pair_texts(spark, SF, langs, logged_pairs(spark, SF)))
    assert P.defects([c[:4] for c in CASES], *models) == [c[4] for c in CASES]
    test_planted_defects_are_found(spark, models)
