"""Defects of literal pairs."""

import random
from dataclasses import replace

import pytest

from tidemark.llm import pairs as P
from tidemark.llm.langid import training_texts
from tidemark.llm.ppm import ByteModels
from tidemark.llm.queries import PAIR_FIT

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def models(spark):
    units = spark.read.parquet(f"{SF}/translation_units.parquet")
    texts = [(spark.read.parquet(f"{SF}/phrases.parquet"), "text", "source_lang"), (units, "target_text", "target_lang")]
    samples = training_texts(spark.read.parquet(f"{SF}/jobs.parquet"), texts, PAIR_FIT)
    return P.Dictionaries.fit(samples), ByteModels.fit(samples, 4)


EN, ES, FR = "The host praised the first draft in the garden.", "El presentador elogió el primer borrador en el jardín.", "Le présentateur a loué le premier brouillon dans le jardin."
CASES = [
    (EN, ES, "en", "es", None),
    (EN, None, "en", "es", "empty"),
    (EN, "​", "en", "es", "empty"),
    (EN, "[empty]", "en", "es", "empty"),
    (EN, "N/A", "en", "es", "empty"),
    ("…", "…", "en", "es", None),
    (EN, "Lo siento, pero no puedo traducir este texto.", "en", "es", "refusal"),
    (EN, "As an AI assistant, I can't translate this passage.\n\n" + ES, "en", "es", "refusal"),
    (EN, "言語モデルとして、そのご依頼にはお応えできません。", "en", "ja", "refusal"),
    ("I can't help you carry the piano.", "No puedo ayudarte a llevar el piano.", "en", "es", None),
    ("I can't translate this text.", "No puedo traducir este texto.", "en", "es", None),
    (EN, EN.upper(), "en", "es", "copied"),
    (EN, "Translation: " + EN, "en", "es", "copied"),
    (EN, EN + " " + EN, "en", "es", "copied"),
    ("主持人在花园里称赞了第一份草稿。", " ".join("主持人在花园里称赞了第一份草稿。"), "zh", "en", "copied"),
    ("Tolubo Nanato", "Tolubo Nanato", "en", "es", None),
    ("37", "37", "en", "es", None),
    ("OK.", "OK.", "en", "es", None),
    (EN, FR, "en", "es", "wrong_language"),
    (EN, "主持人在花园里称赞了第一份草稿。", "en", "es", "wrong_language"),
    (EN, "El presentador elogió el prim", "en", "es", "truncated"),
    (EN, "El presentador elogió el...", "en", "es", "truncated"),
    (EN + " Yes. " + EN, ES, "en", "es", "truncated"),
    (EN[:-1], ES[:-1], "en", "es", None),
    (EN[:-1] + ",", ES[:-1] + ",", "en", "es", None),
    (EN, "พิธีกรชมร่างฉบับแร", "en", "th", "truncated"),
    (EN, "พิธีกรชมร่างฉบับแรกในสวน", "en", "th", None),
    (None, None, "en", "es", "empty"),
    (None, "Hola.", "en", "es", None),
    ("", "", "en", "es", None),
]


@pytest.mark.parametrize(("source", "target", "a", "b", "want"), CASES, ids=range(len(CASES)))
def test_defects(models, source, target, a, b, want):
    assert P.defects([(source, target, a, b)], *models) == [want]


def test_copies_are_cheap():
    assert P.copy_cost("thehostpraisedthefirstdraft", "thehostpraisedthefirstdraft") < 0.35
    assert P.copy_cost("thehostpraisedthefirstdraft", "elpresentadorelogióelborrador") > 0.5


def test_table(spark, models):
    rows = [(1, 0, 5, EN, ES, "en", "es", "x"), (1, 0, 6, EN, None, "en", "es", "x"), (1, 0, 6, EN, None, "en", "es", "x"), (1, 0, 7, None, None, None, None, "x"), (2, 0, 8, EN, EN, None, "es", "x")]
    df = spark.createDataFrame(rows, "ep bigint, idx int, line_id int, source_text string, target_text string, source_lang string, target_lang string, defect string")
    got = {tuple(r) for r in P.find_defects(df, models, ["ep", "idx", "line_id"]).distinct().collect()}
    assert got == {(1, 0, 6, "empty"), (1, 0, 7, "empty"), (2, 0, 8, "wrong_language")}
    assert P.find_defects(df.limit(0), models, ["ep", "idx", "line_id"]).count() == 0


LONG = "The host praised the first draft in the garden, and the guest read the second chapter aloud."
FRAMED = "Here is the original text: "


def test_framed_copy_of_middle_length(models):
    d, _ = models
    a, b = (P._PLAIN.sub("", t).casefold() for t in (LONG, FRAMED + LONG))
    assert P.copy_cost(a, b) <= 0.35 and not P._covers(a, b)
    assert P.is_copied(LONG, FRAMED + LONG, "en", "es", d)
    assert not P.is_copied(LONG, "El presentador elogi\u00f3 mucho: " + LONG[:30], "en", "es", d)


def test_equal_texts_are_cheap_but_for_short_ones():
    assert all(P.copy_cost(LONG[:n], LONG[:n]) <= 0.35 for n in range(20, len(LONG)))
    assert all(P.copy_cost(LONG[:n], LONG[:n]) <= P.EQUAL_SHARE for n in range(13, 40))


def test_known_words_are_no_name(models):
    names = [("Good Morning", "Good Morning", "en", "es"), ("Tolubo Nanato", "Tolubo Nanato", "en", "es")]
    assert P.defects(names, *models) == ["copied", None]


def test_terminal_contexts_of_marked_languages():
    sample = ["the host left", "the guest left", "he left the room", "she left the room"] * 5
    got = P.closing_contexts(sample)
    assert got["host left"] == 1.0 and got["the room"] == 1.0 and "he left" not in got
    assert P.closing_contexts(["他走了吗"] * 5 + ["他走了吗好"] * 6) == {"走了吗好": 1.0}
    d = P.Dictionaries.fit({"en": [t.encode() for t in sample], "th": ["ผู้ฟังเล่า".encode()] * 3})
    said = lambda t: P.is_truncated("ผู้ฟังเล่าถึง", t, "th", "en", d)
    assert not said("Then she left the room") and said("Then she left the") and said("Then she left the room...") and said("“Then she left the room")


def test_languages_outside_the_models(models):
    greek, dutch, german = "Το μικρό σπίτι είναι κοντά στη θάλασσα.", "Het kleine huis staat aan de zee en de zon schijnt vandaag erg fel.", "Gestern kaufte meine Schwester frisches Brot und etwas Käse."
    assert P.defects([(EN, t, "en", "de") for t in (greek, dutch, german)], *models) == ["wrong_language", "wrong_language", None]


def test_planted_defects_are_found(spark, models):
    """Recall and precision on pairs of the largest test set that one rule each made defective; a third stay as they are."""
    jobs = {r["ep"]: (r["source_lang"].strip().lower(), r["target_lang"].strip().lower()) for r in spark.read.parquet(f"{SF}/jobs.parquet").collect()}
    rows = spark.read.parquet(f"{SF}/translation_units.parquet").where("length(target_text) BETWEEN 40 AND 400 AND length(source_text) BETWEEN 40 AND 400 AND ep % 3 = 0")
    whole = lambda t: t.rstrip()[-1:] in ".!?。！？؟।"
    rows = rows.select("ep", "idx", "source_text", "target_text").distinct().orderBy("ep", "idx").collect()
    rows = [r for r in rows if whole(r["source_text"]) and (whole(r["target_text"]) or jobs[r["ep"]][1] == "th")]
    rng, pairs, want = random.Random(3), [], []
    for k, r in enumerate(rows[:9000]):
        a, b = jobs[r["ep"]]
        t, kind = r["target_text"].strip(), None
        way = k % 6
        if way == 0:
            t, kind = rng.choice([None, " ", "…", "[empty]"]), "empty"
        elif way == 1:
            t, kind = rng.choice([str.upper, str.strip, lambda x: f"Translation: {x}"])(r["source_text"]), "copied"
        elif way == 2 and b != "th":
            other = rows[rng.randrange(len(rows))]
            if jobs[other["ep"]][1] in (a, b):
                continue
            t, kind = other["target_text"], "wrong_language"
        elif way == 3 and b != "th":
            t, kind = t[: len(t) * 2 // 3].rstrip(" .!?。！？؟।"), "truncated"
        pairs.append((r["source_text"], t, a, b))
        want.append(kind)
    got = P.defects(pairs, *models)
    for kind in ("empty", "copied", "wrong_language", "truncated"):
        true, found = {i for i, w in enumerate(want) if w == kind}, {i for i, g in enumerate(got) if g == kind}
        assert len(true) > 300 and len(true & found) >= 0.97 * len(true), (kind, len(true & found) / len(true))
        assert len(true & found) >= 0.97 * len(found), (kind, len(true & found) / len(found))


def test_log_batches_are_a_bound_of_the_fit(spark, tmp_path):
    from tidemark.llm.queries import pair_samples

    assert (PAIR_FIT.bytes_each, PAIR_FIT.batches) == (120_000, 2)
    spark.createDataFrame([(1, "en", "es")], "ep bigint, source_lang string, target_lang string").write.parquet(f"{tmp_path}/jobs.parquet")
    spark.createDataFrame([], "ep bigint, idx int, text string").write.parquet(f"{tmp_path}/phrases.parquet")
    spark.createDataFrame([], "ep bigint, idx int, target_text string").write.parquet(f"{tmp_path}/translation_units.parquet")
    events = [(1, i, [(0, f"Word {'abc'[i]}.", "x")]) for i in range(3)]
    spark.createDataFrame(events, "ep bigint, idx int, pairs array<struct<id: int, source_text: string, target_text: string>>").write.parquet(f"{tmp_path}/translate_events.parquet")
    got = {n: sorted(pair_samples(spark, str(tmp_path), replace(PAIR_FIT, batches=n)).get("en", [])) for n in (0, 1, 2)}
    assert got == {0: [], 1: [b"word a"], 2: [b"word a", b"word b"]}
