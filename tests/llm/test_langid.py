"""Byte models against a plain PPM, held-out accuracy, labels and segments."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import langid as G
from tidemark.llm.ppm import ByteModels, KeyTable, grams
from tidemark.llm.queries import language_models


def plain_bits(train, text, order):
    """Code length by walking down the contexts of one language."""
    counts = defaultdict(Counter)
    pad = b"\n" * order
    for t in train:
        s = pad + t
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    bits, s = 0.0, pad + text
    for i in range(order, len(s)):
        for k in range(order, -1, -1):
            c = counts.get(s[i - k : i])
            if not c:
                continue
            total, kinds = sum(c.values()), len(c)
            if s[i] in c:
                bits -= math.log2(c[s[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_scores_are_exact_code_lengths():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    train = {g: [" ".join(word() for _ in range(5)).encode() for _ in range(12)] for g in ("x", "y", "z")}
    texts = [" ".join(word() for _ in range(4)).encode() for _ in range(10)] + [b"", b"QQ\xff", train["x"][0]]
    m = ByteModels.fit(train, 3)
    got = m.score(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(m.langs):
            assert got[i, j] == pytest.approx(plain_bits(train[g], t, 3), rel=1e-4, abs=1e-3)
    assert ByteModels.fit({"x": []}, 2).score([b"ab"]).tolist() == [[16.0]]


def test_key_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000, dtype=np.uint64))
    t = KeyTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert grams(np.frombuffer(b"abc", np.uint8), 2).tolist() == [97, 97 * 256 + 98, 98 * 256 + 99]


@pytest.mark.parametrize(
    ("label", "code"),
    [("en", "en"), (" EN-us ", "en"), ("zh_CN", "zh"), ("German", "de"), ("fra", "fr"), ("日本語", "ja"), ("und", None), ("??", None), ("", None), (None, None), ("nl", ""), ("N/A", None)],
)
def test_labels(label, code):
    assert G.label_code(label) == code


def test_best_path():
    costs = np.array([[1, 50, 50], [30, 28, 40], [1, 90, 90], [90, 1, 90], [70, 1, 90]], float)
    assert G.best_path(costs, 20, 2).tolist() == [0, 0, 0, 1, 1]
    assert G.best_path(costs[:3], 20, 2).tolist() == [0, 0, 0]


def test_inner_language_pays_once():
    # 45 bits are won by an inner sentence: more than its entry, less than twice of it
    costs = np.array([[1, 90, 90], [50, 5, 60], [1, 90, 90]], float)
    assert G.best_path(costs, 30, 4).tolist() == [0, 1, 0]
    costs[1, 0] = 38
    assert G.best_path(costs, 30, 4).tolist() == [0, 0, 0]


def test_best_path_against_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(60):
        costs = rng.integers(0, 60, (5, 3)).astype(float)

        def price(p):
            new, changes = len(set(p)) - 1, sum(a != b for a, b in zip(p, p[1:]))
            return sum(costs[i, j] for i, j in enumerate(p)) + 30 * new + 4 * (changes - new)

        assert price(G.best_path(costs, 30, 4).tolist()) == min(price(p) for p in itertools.product(range(3), repeat=5))


def test_romanise():
    assert G.romanise("Щука пьёт", "ru") == "shchuka pyot"
    assert G.romanise("युवा अभिनेता ने दूसरा", "hi") == "yuvaa abhinetaa ne doosaraa"
    assert G.romanise("x", "en") is None


@pytest.fixture(scope="module")
def models(spark):
    return language_models(spark, "/root/testdata/sf0.01")


def test_held_out_accuracy(spark, models):
    jobs = {r["ep"]: r["source_lang"].lower() for r in spark.read.parquet("/root/testdata/sf0.1/jobs.parquet").collect()}
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.1/phrases.parquet").where("length(text) > 40").collect() if r["ep"] > 1200]
    got = np.array(models.langs)[models.score([G.plain(r["text"]) for r in rows]).argmin(1)]
    right = np.array([jobs[r["ep"]] for r in rows]) == got
    assert right.mean() > 0.995, right.mean()


def test_documents(spark, models):
    en, de, zh = "The host praised the first draft in the garden.", "Der Gast hat im Garten den ersten Entwurf gelobt.", "主持人在花园里称赞了第一份草稿。"
    docs = [
        (1, f"{en} {en}", "en_US"), (2, f"{en} {en}", "de"), (3, de, None), (4, f"{en} {de} {de}", "en"), (5, f"{zh} {en} {zh}", "zh"),
        (6, f"The host said: “{zh}” {en}", "en"), (7, None, "en"), (8, "123 !", None), (9, "", None), (10, "KATO — " + de + "\nRITO — " + de, "German"), (10, "KATO — " + de + "\nRITO — " + de, "German"),
    ]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, lang string, seg_no int")
    seg = G.identify(df, models)
    got = {tuple(r) for r in G.label_defects(seg).select("doc_id", "defect", "seg_no", "char_start", "lang").collect()}
    assert got == {
        (2, "wrong", 0, 0, "en"), (3, "missing", 0, 0, "de"), (4, "mixed", 0, 0, "en"), (4, "mixed", 1, len(en) + 1, "de"),
        (5, "mixed", 0, 0, "zh"), (5, "mixed", 1, len(zh) + 1, "en"), (5, "mixed", 2, len(zh) + len(en) + 2, "zh"),
    }
    assert all(0.5 <= r["confidence"] <= 1 for r in seg.collect())


def test_confidence_and_unknown_languages(spark, models):
    greek = "Το μικρό σπίτι είναι κοντά στη θάλασσα και ο ήλιος λάμπει κάθε μέρα."
    near = "O presentador elogiou o primeiro."
    df = spark.createDataFrame([(1, greek, "el"), (2, greek, None), (3, greek, "de"), (4, near, "pt"), (5, "The host praised the first draft.", "en")], "doc_id bigint, text string, lang string")
    seg = G.identify(df, models)
    got = {r["doc_id"]: (r["lang"], r["confidence"]) for r in seg.collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["und"] * 3 and got[1][1] < 0.6 and got[5][1] > 0.95
    assert got[4][1] < got[5][1]
    assert {(r["doc_id"], r["defect"]) for r in G.label_defects(seg).collect()} == {(2, "missing"), (3, "wrong")}
    assert G.confidence(np.array([10.0, 10.0]), 20) == 0.5
    assert G.identify(df.limit(0), models).count() == 0
    assert G.identify(df.limit(0), models).count() == 0
