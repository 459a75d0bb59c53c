"""p1_found does less work for the same results: against the longer ways that it leaves out."""

import pytest

from tidemark.llm import pairs as P
from tidemark.llm import sentences as S
from tidemark.llm.langid import plain, plains
from tidemark.llm.queries import table

EN, ES = "The host praised the first draft in the garden.", "El presentador elogió el primer borrador en el jardín."
ODD = [
    "",
    " ",
    "\n",
    "İstanbul ΑΣ ΣΑΣ. ﬁne",
    "MARÍA: Sí.\nNo.",
    "[00:01] “Hi,” he said: see x.example.org/a. Go-\non",
    "𠀀𠮷 a b 😀 ok",
    "１２：３０ 帕帕 ABC 说。",
    "a\x1cb　c d",
    "1. One\n2. Two\n\n3. Three",
    'She "said. Then" left " again. No',
    "我们 走 吧 好 吗？但是他来了吗然而没有",
    "บริษัท ABC จก. มา แล้ว ค่ะ แต่ ไม่",
    "Dr. Who met J. R. Name at 5 p.m. in St. Louis.Then (see No. 4.) left…",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return ODD + [r[0] for n, c in (("phrases", "text"), ("translation_units", "target_text")) for r in table(spark, sf, n).select(c).collect() if r[0]]


def test_unlike_texts_are_not_compressed(monkeypatch):
    dicts = P.Dictionaries.fit({"en": [plain(EN)] * 3, "es": [plain(ES)] * 3})
    asked = []
    monkeypatch.setattr(P, "copy_cost", lambda a, b: asked.append((a, b)) or 0.0)
    assert not P.is_copied(EN, ES, "en", "es", dicts) and not asked
    assert P.is_copied(EN, EN + " " + EN, "en", "es", dicts) and asked


def test_sentences_read_together(texts):
    parts = texts + [t[a:b] for t in texts for a, b in S.spans(t)]
    assert plains(parts) == [plain(t) for t in parts]
    assert plains([]) == [] and plains([""]) == [b""]


def test_letters_read_together(texts):
    assert P.bare([None, *texts]) == ["", *[P._PLAIN.sub("", t).casefold() for t in texts]]


def test_sure_path_is_the_best_of_the_lattice(texts):
    words = S._FIXED_WORDS
    for t in [*texts, *map(" ".join, zip(texts, texts[1:], strict=False))]:
        events = S._events(t, S._is_thai(t))
        link = S._lattice(t, words, events, 0, (0.0, S._skip(t, 0), 1 if S._LIST_START.match(t) else 0, None), set())
        cuts = []
        while link:
            cuts, link = [link[0], *cuts], link[1]
        # the end of the text is no cut of its own
        assert [c for c in S._best_cuts(t, S._is_thai(t), words) if S._skip(t, c) < len(t)] == [c for c in cuts if S._skip(t, c) < len(t)], t
