"""Sentence units of literal texts in all scripts, and what holds for any text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.sentences import Words, load_words, spans, split_sentences


def cut(t):
    return [t[s:e] for s, e in spans(t)]


CASES = [
    ["What a night!", "The host lost it at 7 p.m. in Room No. 4."],
    ["He met Dr. Gitodomi on Monday.", "Good."],
    ["It was for Veriramin Ltd.", "Right!"],
    ["She came at 7 p.m.", "The listener left."],
    ["“Where is it?” asked the director.", "Yes."],
    ["The host said: “Where is it?”", "“Stop it!” asked the actor."],
    ["He whispered “Stop it! I don't know.” and left.", "Good."],
    ["(Is that really true?)", "The guest found… the subtitle."],
    ["Listen (see p. 9, vol. 3) to J. R. Kafupaven e.g. for the trailer."],
    ["Das war am 5. Mai z. B. Vorschau (vgl. S. 7, Bd. 3).", "„Bist du sicher?“, fragte der Gast.", "Für die Mifune Co. KG den Satz."],
    ["¿Quién lo hubiera pensado?", "Fue para Totobon S. A. a medianoche.", "Para Pamiran S. A.", "¡Silencio, por favor!"],
    ["Quelle nuit !", "Il a dit : « Où est-ce ? »", "M. Dofukamin arrive."],
    ["Nella sala n. 4 con il dott. Sotefu per la Mipasona S.p.A. nel giardino.", "Sì."],
    ["Он был в каб. № 2 с г. Сосоги (см. стр. 8, т. 4).", "«Хватит!» — спросил ведущий.", "Да."],
    ["شرح د. سوتولو (انظر ص. 2) الساعة 8 م. كما تقرر.", "قال: «أين هو؟»", "في النهاية، وجد الضيف السؤال."],
    ["कमरा सं. 2 में डॉ. रालुका ने “रुक जाओ! मुझे नहीं पता।” कहा।", "हाँ।"],
    ["司会者はDr. ボベボンとNo. 4の部屋で見つけました。", "「どこですか？」と制作者は尋ねました。", "なんて夜だ！"],
    ["“它在哪里？”录音师问道。", "主持人说：“我不知道。”", "好。"],
    ['손님이 말했습니다: "어디 있어요?"', '"네." 하고 물었습니다.', "네.", "정말 대단한 밤이에요!"],
    ["ผู้ฟังพบเทปเก่าเวลา 3:55 น. ตามนัดกับ J. R. เทคา", "เขาพูดว่า“หยุด นะ”", "ดีครับ"],
    ["Yes.", "No way!", "What?!"],
]


@pytest.mark.parametrize("sentences", CASES, ids=range(len(CASES)))
def test_joined_sentences_come_apart(sentences):
    assert cut(" ".join(sentences)) == sentences


def test_lists_wraps_and_missing_blanks():
    assert cut("1. Good.\n2. The host left.\n3. Yes.") == ["1. Good.", "2. The host left.", "3. Yes."]
    assert cut("The guest in Room No.\n1. Good.") == ["The guest in Room No.\n1.", "Good."]
    assert cut("What happened next?Kadoton left.Then rain") == ["What happened next?", "Kadoton left.", "Then rain"]
    assert cut("没想到，邻\n居改正了。好。") == ["没想到，邻\n居改正了。", "好。"]
    assert cut("See veda.example or v2.8.3 at 9:47.") == ["See veda.example or v2.8.3 at 9:47."]


SPACELESS = [
    ["我们看完了", "他走了"],
    ["我昨天去了北京", "天气很好", "我们去了长城"],
    ["私は学生です", "あなたは先生です"],
    ["彼は来ました", "私は帰った"],
]


@pytest.mark.parametrize("sentences", SPACELESS, ids=range(len(SPACELESS)))
def test_blanks_between_spaceless_letters(sentences):
    assert [" ".join(sentences)[s:e] for s, e in spans(" ".join(sentences), load_words())] == sentences


def test_word_lattice():
    w = load_words()
    assert w.gain("他走了吗", "但是我们还在", "none") > 0  # a particle and a connective need no mark
    assert w.gain("他走了", "我们的家", "none") < 0
    assert w.gain("新しい本を", "私は読んだ", "blank") < 0  # an object marker closes nothing
    assert w.gain("我觉得今", "天气很好的", "blank") < w.gain("我觉得很好", "天气很好的", "blank")  # 今天 crosses the gap
    assert w.gain("李", "明", "blank") < 0 and w.gain("他看了", "一本书的人", "break") < 0
    assert Words.of({}).path("私は学生です")[-1] == 6 and load_words("/nowhere").costs


def test_paths_choose_between_quotation_and_lone_mark():
    assert cut('He said "Stop it! Now." and left. Bye.') == ['He said "Stop it! Now." and left.', "Bye."]
    assert cut('It is 5" long. He left. She stayed.') == ['It is 5" long.', "He left.", "She stayed."]
    assert cut("1. Go home at 2 p. m.\n2. Stay.") == ["1. Go home at 2 p. m.", "2. Stay."]


def test_held_out_sentences_of_all_languages(spark, sf):
    """Texts of one sentence each, joined by three, come apart again."""
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables lack some languages
    jobs = spark.read.parquet(f"{sf}/jobs.parquet").selectExpr("ep", "lower(trim(target_lang)) lang").distinct()
    units = spark.read.parquet(f"{sf}/translation_units.parquet").select("ep", "idx", "target_text").distinct().join(jobs, "ep")
    by_lang = {}
    for r in units.where("target_text is not null").orderBy("ep", "idx").collect():
        t = " ".join(r["target_text"].split())
        end = t[-1:] in ".!?。！？؟।" or r["lang"] == "th"
        if len(spans(t)) == 1 and end and len(t) < 400 and any(c.isalpha() for c in t):
            by_lang.setdefault(r["lang"], []).append(t)
    true = found = both = 0
    for lang, texts in by_lang.items():
        for i in range(0, len(texts) - 2, 3):
            want, at = set(), 0
            joined = " ".join(texts[i : i + 3])
            for t in texts[i : i + 3]:
                want.add((at, at + len(t)))
                at += len(t) + 1
            got = set(spans(joined, load_words()))
            true, found, both = true + len(want), found + len(got), both + len(want & got)
    assert len(by_lang) >= 12 and true > 200
    assert both >= 0.99 * true and both >= 0.99 * found


def test_suspension_points():
    assert cut("The guest… left... The end...") == ["The guest… left... The end..."]
    assert cut("听众……改正了。好……") == ["听众……改正了。", "好……"]


def test_blank_and_null():
    assert spans(None) == [] and spans("") == [] and spans(" \n　") == []


@given(st.text(alphabet="aB .?!…。“”\"()\n1ก你नА", max_size=80))
@settings(max_examples=400, deadline=None)
def test_all_but_white_space_is_covered(text):
    got = spans(text)
    assert "".join("".join(text[s:e].split()) for s, e in got) == "".join(text.split())
    assert all(s < e for s, e in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert all(not text[s].isspace() and not text[e - 1].isspace() for s, e in got)


@pytest.mark.parametrize("text", ["“" * 50000, "(" * 20000 + ")" * 20000, "A b. " * 50000, "." * 50000])
def test_very_long_texts(text):
    assert "".join("".join(text[s:e].split()) for s, e in spans(text)) == "".join(text.split())


def test_table(spark):
    rows = [(1, 0, "Ab cd. Ef gh.", 7), (1, 0, "Ab cd. Ef gh.", 7), (1, 1, None, 7), (None, 2, "Hi.", 7), (1, 3, "  ", 7)]
    df = spark.createDataFrame(rows, "ep bigint, idx int, text string, sent_no int")
    got = {tuple(r) for r in split_sentences(df, "text", ["ep", "idx"]).distinct().collect()}
    assert got == {(1, 0, 0, 0, 6), (1, 0, 1, 7, 13), (None, 2, 0, 0, 3)}
    assert split_sentences(df.limit(0), "text", ["ep", "idx"]).count() == 0
