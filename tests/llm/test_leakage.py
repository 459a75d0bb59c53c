"""Leaks against a plain search for common stretches."""

import random

import numpy as np
import pytest

from tidemark.llm import leakage as K

WORDS = "the host found a long story in the garden on monday with".split()


def passage(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.7 else "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    items = [(100 + i, passage(rng, 40), "en") for i in range(6)] + [(200, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(90)), "ZH"), (201, "short", "en"), (202, None, "en")]
    docs = []
    for d in range(40):
        body = passage(rng, 60)
        if d % 3 == 0:
            t = rng.choice(items[:7])[1]
            n = rng.choice([35, 39, 40, 60, 79, 80, 81, 100, 150, 400])
            k = rng.randrange(max(1, len(t) - n))
            body += " — " + t[k : k + n].upper().replace(" ", ",\n") + "! " + passage(rng, 10)
        docs.append((d, body, "x"))
    return docs + [(90, None, "x"), (91, "", "x"), (92, "!!!", "x"), docs[0]], items


def brute(docs, items):
    out = set()
    for i, t, g in items:
        s, n = K.stream(t), 40 if (g or "").lower() in ("ja", "ko", "zh") else 80
        grams = {s[k : k + n] for k in range(len(s) - n + 1)}
        for d, u, _ in docs:
            x = K.stream(u)
            if any(x[k : k + n] in grams for k in range(len(x) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_all_and_only_the_leaks(spark, limit):
    docs, items = corpus(4)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    t = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    got = {(r["doc_id"], r["item_id"]) for r in K.find_leaks(d, t, K.Rule(broadcast_bytes=limit)).collect()}
    assert got == brute(docs, items) and len(got) > 3
    some = K.find_leaks(d, t, K.Rule(broadcast_bytes=limit, substitutions=1)).collect()
    assert got <= {(r["doc_id"], r["item_id"]) for r in some}
    assert K.find_leaks(d, t.limit(0)).count() == 0 and K.find_leaks(d.limit(0), t).count() == 0


def test_substitutions_are_bridged():
    rng = random.Random(1)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    doc = item[:60] + "#".replace("#", "7") + item[61:130]
    idx = K.index_items([1], [item], ["en"], rule := K.Rule(substitutions=1))
    assert K.find_in_batch([doc], idx, rule) == [(0, 0, 69, 130)]
    assert K.find_in_batch([doc], K.index_items([1], [item], ["en"], K.Rule()), K.Rule()) == []


@pytest.mark.parametrize(("length", "lang", "k"), [(40, "ja", 1), (40, "ja", 2), (40, "zh", 3), (80, "en", 1), (80, "en", 2), (80, "en", 4)])
def test_recall_of_stretches_with_substitutions(length, lang, k):
    """No stretch of the shortest length with the allowed substitutions is missed."""
    rng = random.Random(length * 10 + k)
    letters = [chr(0x4E00 + i) for i in range(2000)] if lang != "en" else list("abcdefghijklmnopqrstuvwxyz")
    item = "".join(rng.choice(letters) for _ in range(400))
    rule = K.Rule(substitutions=k)
    idx = K.index_items([1], [item], [lang], rule)
    docs = []
    for _ in range(200):
        at = rng.randrange(len(item) - length)
        part = list(item[at : at + length])
        for i in rng.sample(range(1, length - 1), k):
            part[i] = "0"
        docs.append("".join(rng.choice("9876543") for _ in range(rng.randrange(60))) + "".join(part) + "".join(rng.choice("9876543") for _ in range(30)))
    assert {r for r, *_ in K.find_in_batch(docs, idx, rule)} == set(range(200))
    with pytest.raises(ValueError):
        K.Rule(substitutions=9)


def test_longest_run():
    eq = np.array([1, 1, 0, 1, 1, 1, 0, 1], bool)
    assert [K.longest_run(eq, k) for k in (0, 1, 2)] == [3, 6, 8]
    assert K.longest_run(np.array([], bool), 0) == 0


def test_stream():
    assert K.stream("Ｈｏｎｅｓｔ, Ⅳ! ﬁ") == "honestivfi" and K.stream(None) == ""
