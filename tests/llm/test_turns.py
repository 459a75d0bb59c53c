"""Clean speech and turns."""

import itertools
import random

import pytest

from tidemark.llm import turns as T

ROSTER = T.Roster([("host", "Fufu Bokarin", "spk_0"), ("guest", "Mifu Funabo", "spk_1"), ("guest_2", "Mifu Telu", "spk_2")])

CLEAN = [
    ("[00:00:05] Uh — What a night!", "en", "What a night!", None, 5.0),
    (">> MIFU FUNABO: ummmm (What a night!)  [00:02:02]  Right!", "en", "(What a night!) Right!", "guest", 122.0),
    ("- Fufu: 02:10 - The host {music 4s} left at 9:47.", "en", "The host left at 9:47.", "host", 130.0),
    ("00:00:23.522 --> 00:00:25.919 لذلك اممم وجد", "ar", "لذلك وجد", None, 23.522),
    ("[Fufu Bokarin] 比较了，呃、缺少 ♪ 掌声 ♪ 的。", "zh", "比较了， 缺少 的。", "host", None),
    ("Fufu Bokrain — um Mitternacht", "de", "um Mitternacht", "host", None),
    ("음향 기사가 — 흠흠 — 두 번째", "ko", "음향 기사가 — 두 번째", None, None),
    ("Zum Beispiel: der Gast hat (vgl. S. 4) öhhh gelobt.", "de", "Zum Beispiel: der Gast hat (vgl. S. 4) gelobt.", None, None),
    ("【laughter 7s】", "en", "", None, None),
    ("*تصفيق*", "ar", "", None, None),
    ("um, Fufu Bokarin: Hello there", "en", "Hello there", "host", None),
    ("[00:01] uh Fufu: Hi", "en", "Hi", "host", 1.0),
    ("[Mifu Funabo] 02:06 - hmm... The reporter left. — Hmmm — Yes.", "en", "The reporter left. — Yes.", "guest", 126.0),
    ("well uh-huh yes", "en", "well uh-huh yes", None, None),
    ("[door slams] Who is it?", "en", "Who is it?", None, None),
    ("He fell (gunshot) and died", "en", "He fell and died", None, None),
    ("He left (see p. 9, vol. 3) at once (What a night!).", "en", "He left (see p. 9, vol. 3) at once (What a night!).", None, None),
    ("We left at 00:02:10 and then 02:10 - it rained", "en", "We left at 00:02:10 and then 02:10 - it rained", None, None),
]


@pytest.mark.parametrize(("text", "lang", "said", "who", "at"), CLEAN, ids=range(len(CLEAN)))
def test_clean(text, lang, said, who, at):
    assert T.clean(text, lang, ROSTER) == (said, who, at)


@pytest.mark.parametrize(
    ("label", "who"),
    [("Guest (cont.)", "guest"), ("host:", "host"), ("FUFU", "host"), ("Fufu Bkoarin", "host"), ("SPEAKER_01", "guest"), ("Speaker 2", "guest_2"), ("spk-0", "host"),
     (">> guest_2", "guest_2"), ("Mifu T.", "guest_2"), ("Mifu", None), ("unknown", None), ("?", None), (" ", None), (None, None), ("Nobody", None)],
)
def test_labels(label, who):
    assert ROSTER.find(label) == who


def best_by_brute_force(model, kinds):
    def score(states):
        before, total = T.START, 0.0
        for k, x in zip(kinds, states):
            total += model.follows[before][x] + model.looks[k][x]
            before = x
        return total

    best = max(itertools.product(range(T.START), repeat=len(kinds)), key=score)
    return score(best), score


@pytest.mark.parametrize("seed", range(12))
def test_viterbi_equals_brute_force(seed):
    rng = random.Random(seed)
    kinds = tuple(rng.choice(T.KINDS) for _ in range(rng.randrange(1, 6)))
    m = T.TurnModel.fit()
    best, score = best_by_brute_force(m, kinds)
    found = m.labels(kinds)
    # the states behind the labels: the same label may stand before or in the speech
    options = [[x for x in range(T.START) if T.STATES[x] == y] for y in found]
    assert max(score(x) for x in itertools.product(*options)) == pytest.approx(best)


def test_the_sequence_decides():
    m = T.TurnModel.fit()
    assert m.labels(("bare", "text")) == (T.TIME, T.SPEECH)
    assert m.labels(("text", "bare", "text")) == (T.SPEECH,) * 3
    assert m.labels(("fill", "name", "text")) == (T.FILL, T.SPK, T.SPEECH)
    assert m.labels(()) == ()
    # without transitions the same token has the same label everywhere
    flat = T.TurnModel(m.looks, [[0.0] * T.START] * (T.START + 1))
    assert flat.labels(("text", "bare", "text"))[1] == flat.labels(("bare", "text"))[0]


def test_rows_that_label_themselves():
    said = lambda text, start, label: T.self_labelled(text, "en", ROSTER, start, label, 1.5)
    assert said("[00:02:02] Fufu: Hi um there", 121.0, "host") == [("clock", T.TIME), ("name", T.SPK), ("text", T.SPEECH), ("fill", T.FILL), ("text", T.SPEECH)]
    assert said("Meet 00:09:47 at", 3.0, None) == [("text", T.SPEECH), ("bare", T.SPEECH), ("text", T.SPEECH)]
    assert said("[00:02:02] Hi", 3.0, None) is None and said("[00:02:02] Hi", None, None) is None
    assert said("Fufu: Hi", 1.0, "guest") is None and said("[door] Hi", 1.0, None) is None
    more = T.TurnModel.fit([[("note", T.SPEECH), ("text", T.SPEECH)]] * 5000)
    assert more.labels(("note", "text"))[0] == T.SPEECH  # rows outweigh the prior counts


def loop(rows):
    """Turns by a plain loop over (ep, idx, at, speaker, n)."""
    out, last, ep0 = [], None, None
    for ep, idx, at, sp, n in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if ep != ep0:
            ep0, last, cur = ep, None, None
        sp = last = sp or last
        if cur and cur[3] == sp:
            cur[2], cur[4] = idx, cur[4] + n
        else:
            cur = [ep, idx, idx, sp, n]
            out.append(cur)
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_turns_over_stretches_equal_a_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(T, "STRETCH_S", 10)
    rng = random.Random(seed)
    rows = [(ep, i, float(rng.randrange(200)), rng.choice([None, None, "a", "b"]), rng.randrange(1, 9)) for ep in range(6) for i in range(60)]
    df = spark.createDataFrame([(e, i, a, a + 1, s, n) for e, i, a, s, n in rows * 2], "ep bigint, idx int, at_s double, end_s double, speaker string, n_letters bigint")
    got = sorted((tuple(r) for r in T.speaker_turns(df).select("ep", "first_idx", "last_idx", "speaker", "n_letters").collect()), key=str)
    assert got == loop(rows)


def test_table(spark):
    rows = [
        (1, 0, 1.0, 2.0, "um, Hi there.", "host", "x"), (1, 1, None, None, "[00:00:04] Yes.", None, "x"), (1, 2, 3.0, 3.5, None, "guest", "x"), (1, 3, 5.0, 6.0, "[music]", "guest", "x"),
        (1, 4, float("nan"), None, "Late", "guest", "x"), (1, 5, 4.5, 5.0, "", "guest", "x"), (2, 0, 0.0, 1.0, "Hm Ja", "?", "x"),
    ]
    df = spark.createDataFrame(rows, "ep bigint, idx int, start_s double, end_s double, text string, speaker string, lang string")
    refs = spark.createDataFrame([(1, "host", "Fufu Bokarin", "spk_0"), (1, "guest", None, None), (None, "x", None, None)], "ep bigint, speaker string, display_name string, diar_label string")
    jobs = spark.createDataFrame([(1, "EN"), (2, None)], "ep bigint, source_lang string")
    spoken = T.clean_rows(df, T.cast_of(refs, jobs), T.fit_model(df, T.cast_of(refs, jobs)))
    got = sorted((tuple(r) for r in T.speaker_turns(spoken).select("ep", "first_idx", "last_idx", "speaker", "n_letters").collect()), key=str)
    assert got == [(1, 0, 1, "host", 10), (1, 4, 4, "guest", 4), (2, 0, 0, None, 4)]
    assert T.speaker_turns(T.clean_rows(df.limit(0), T.cast_of(refs, jobs))).count() == 0
