"""Languages of documents and of the segments of mixed documents.

Sentences are scored by the byte models of `ppm`, fitted on a bounded sample of rows whose language the
episode's job states. The best path through a document's sentences pays for each change of language, so
that one-word sentences don't break a segment; a path with two languages makes a mixed document. Quotations,
addresses, speaker names and clock times inside a sentence don't count.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lexicon as L
from tidemark.llm.ppm import ByteModels
from tidemark.llm.sentences import spans
from tidemark.session import share, shared


@dataclass(frozen=True)
class Fit:
    """Bounds of the fitted sample and the cost of a change of language."""

    episodes: int = 30  # sampled of each language, as source and as target
    rows: int = 20  # of an episode
    longest: int = 2_000  # characters of a sampled row
    bytes_each: int = 60_000  # of sample text of each language
    batches: int = 2  # of an episode's translation log, for a sample of the pairs
    order: int = 4
    switch_bits: float = 30.0  # for a language that is new to a document
    known_bits: float = 4.0  # between languages that a document is known to hold
    seed: int = 11
    slice_chars: int = 1_000_000  # of documents that are scored together; bounds a worker's memory
    odds_bytes: int = 8  # a lead of one bit in so many bytes doubles the odds
    strange_bits: float = 9.0  # a byte: no language of the models costs so much
    strange_bytes: int = 64  # from which a segment can be of no known language


#: Language of a segment that none of the models can write in fewer bits than it has.
UNKNOWN = "und"
LABELS = {name: code for code, names in L.LANGUAGE_NAMES.items() for name in (code, *names.split())}

_QUOTE = regex.compile(r"“[^“”]{1,400}”|„[^„“”]{1,400}[“”]|«[^«»]{1,400}»|「[^「」]{1,400}」|『[^『』]{1,400}』|\"[^\"\n]{1,400}\"")
_QUOTE_MARK = re.compile("[“„«「『\"]")
_ADDRESS = regex.compile(r"\S*[\p{Latin}\d]\.[\p{Latin}]{3,}[\p{Latin}/.]*")
#: What any address holds; its own pattern is slow.
DOTTED = re.compile(r"\S\.\S{3}")
_CLOCKS = regex.compile(r"\[[^\]\n]{1,20}\]|\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}(?:\s*-->\s*\d{1,2}:\d{2}:\d{2}[.,]\d{1,3})?")
_NAME = regex.compile(r"^[\s\d>•*\-–—#.)\[\]]*\p{Lu}[\p{L}\p{M}.'’]{0,24}(?:[ _]\p{L}[\p{L}\p{M}.]{0,24}){0,2}\s*(?:[:：]|\s[—–])(?:\s|$)")
_WRAP = regex.compile(r"(?<=\p{L})-\s*\n\s*(?=\p{Ll})")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
#: Without these `_cut` changes nothing.
_CUT_MARK, _DOT = re.compile('[“„«「『"\\[:—–\n]'), re.compile(r"\.\S{3}")
_LETTER = regex.compile(r"\p{L}")
_LATIN = regex.compile(r"\p{Latin}+")
#: A letter of another script than Latin stands above the first range; a lower-case Latin one in the second ranges.
_BEYOND = re.compile("[\u0250-\U0010ffff]")
_MAY_LATIN = re.compile("[a-z\u00aa-\u02ff\u1d00-\u1eff\u2071-\u2188\u2c60-\u2c7f\ua720-\uab6f\ufb00-\ufb06\uff21-\uff5a\U00010780-\U000107ff\U0001df00-\U0001dfff]")
#: Blanks for what is no letter of an ASCII text.
_ASCII_LETTERS = {c: c if chr(c).isalpha() else " " for c in range(128)}
_THAI_PART = regex.compile(r"\s+")
_WORDS = regex.compile(r"\p{L}{2,}")
_THAI_LETTER = regex.compile(r"\p{Thai}")


def label_code(label: str | None) -> str | None:
    """Two-letter code a label names; '' for a language outside the list; None if it names none."""
    if label is None:
        return None
    s = label.strip().casefold()
    if s in L.NO_LANGUAGE:
        return None
    got = LABELS.get(s)
    if got:
        return got
    head = regex.split(r"[-_ ]", s, maxsplit=1)[0]
    got = LABELS.get(head)
    if got:
        return got
    return "" if regex.fullmatch(r"\p{L}{2,20}", head) else None


def plain(sentence: str) -> bytes:
    """What the models read of a sentence: lower-case letters and single blanks."""
    s = _cut(sentence if sentence.isascii() else unicodedata.normalize("NFKC", sentence))
    if s.isascii():
        return " ".join(s.translate(_ASCII_LETTERS).split()).lower().encode()
    return _own_script(_OTHER.sub(" ", s).strip().lower()).encode()


def _cut(s: str) -> str:
    """A sentence in normal form without quotations, addresses, clock times and the speaker's name."""
    # each pattern is tried only where a mark it needs stands
    for gone, may in ((_QUOTE, _QUOTE_MARK.search(s)), (_ADDRESS, "." in s and DOTTED.search(s)), (_CLOCKS, "[" in s or s.count(":") > 1)):
        if not may:
            continue
        cut = gone.sub(" ", s)
        if _LETTER.search(cut):
            s = cut
    m = _NAME.match(s) if ":" in s or "—" in s or "–" in s else None
    if m:
        s = s[m.end() :]
    if "-" in s and "\n" in s:
        s = _WRAP.sub("", s)
    return s


def _own_script(s: str) -> str:
    """The lower-case letters without Latin words, where they are the smaller part of a text of another script."""
    if _BEYOND.search(s) and _MAY_LATIN.search(s):
        latin = sum(map(len, _LATIN.findall(s)))
        if 0 < latin < 0.7 * sum(map(len, s.split())):
            cut = _OTHER.sub(" ", _LATIN.sub(" ", s)).strip()
            # accented words are Latin throughout
            s = cut or s
    return s


#: Made by `_kept`; a dict, as a cached function does not travel to workers without the package.
_TABLES: dict[tuple[str, int], np.ndarray] = {}


def _kept(kept: regex.Pattern, size: int) -> np.ndarray:
    """By code point, whether the pattern of a run of characters holds it."""
    table = _TABLES.get((kept.pattern, size))
    if table is None:
        table = _TABLES[kept.pattern, size] = np.zeros(size, bool)
        for m in kept.finditer("".join(map(chr, range(size)))):
            table[m.start() : m.end()] = True
    return table


def only(texts: list[str], kept: regex.Pattern, blank: bool) -> str:
    """A line for each text without line feeds, with the characters in runs of `kept`; others are left out or, with `blank`,
    make one blank between two runs. All texts are worked on as one array."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return ""
    inside = _kept(kept, 0x10000 if codes.max() < 0x10000 else 0x110000)[codes]
    inside |= codes == ord("\n")
    if blank:
        codes = np.where(inside, codes, ord(" "))
        # the first one of other characters
        inside[1:] |= inside[:-1] & (codes[1:] == ord(" ")) & (codes[:-1] != ord("\n"))
    out = codes[inside].tobytes().decode("utf-32-le", "surrogatepass")
    return out.replace(" \n", "\n").rstrip(" ") if blank else out


def plains(sentences: list[str]) -> list[bytes]:
    """`plain` of each sentence, all in one array."""
    lines = [s if s.isascii() else unicodedata.normalize("NFKC", s) for s in sentences]
    for i, s in enumerate(lines):
        if _CUT_MARK.search(s) or _DOT.search(s):
            lines[i] = _cut(s).replace("\n", " ")
    if not lines:
        return []
    return [s.encode() if s.isascii() else _own_script(s).encode() for s in only(lines, _LETTERS, True).lower().split("\n")]


def _parts(text: str) -> list[tuple[int, int]]:
    """Sentences of a document; Thai runs into another script at a blank make two."""
    out = []
    for s, e in spans(text):
        part = _QUOTE.sub(lambda m: "x" * len(m[0]), text[s:e])
        if _THAI_LETTER.search(part) is None or not _WORDS.search(_THAI_LETTER.sub("", part)):
            out.append((s, e))
            continue
        # runs of blank-separated chunks that are Thai or not
        runs: list[list] = []
        at = s
        for chunk in _THAI_PART.split(part):
            i = s + part.index(chunk, at - s)
            at = i + len(chunk)
            thai = _THAI_LETTER.search(chunk) is not None
            if runs and runs[-1][0] == thai:
                runs[-1][2] = at
                runs[-1][3] += bool(_WORDS.search(chunk))
            else:
                runs.append([thai, i, at, int(bool(_WORDS.search(chunk)))])
        merged: list[list] = []
        for r in runs:
            # a few foreign words inside a Thai sentence stay in it
            if merged and (not r[0] and r[3] < 3 or r[0] and not merged[-1][0] and merged[-1][3] < 3):
                merged[-1][2] = r[2]
                merged[-1][0] = merged[-1][0] or r[0]
            elif merged and merged[-1][0] == r[0]:
                merged[-1][2] = r[2]
            else:
                merged.append(r)
        out.extend((r[1], r[2]) for r in merged)
    return out


def best_path(costs: np.ndarray, switch: float, known: float) -> np.ndarray:
    """Language index of each sentence on the cheapest path.

    Each language beyond the first costs `switch` once, with one change; further changes cost `known`.
    Sets of languages are tried in the order of what they cost at least.
    """
    best = costs.argmin(1)
    if (best == best[0]).all():
        return best

    def priced(langs: np.ndarray) -> tuple[float, np.ndarray]:
        path = langs[_viterbi(costs[:, langs], known)]
        new = len(np.unique(path)) - 1
        changes = int((path[1:] != path[:-1]).sum())
        return float(costs[np.arange(len(path)), path].sum()) + switch * new + known * (changes - new), path

    found = min(priced(np.array([costs.sum(0).argmin()])), priced(np.unique(_viterbi(costs, switch))), key=lambda x: x[0])
    least = float(costs.min(1).sum())
    size = 2
    while size <= costs.shape[1] and least + switch * (size - 1) < found[0]:
        # all sets of up to three languages, then one more to those of the best path
        held = set(found[1].tolist())
        sets = combinations(range(costs.shape[1]), size) if size <= 3 else [(*held, j) for j in range(costs.shape[1]) if j not in held]
        bounds = sorted((float(costs[:, s].min(1).sum()) + switch * (len(s) - 1), s) for s in map(list, sets))
        for bound, s in bounds:
            if bound >= found[0]:
                break
            found = min(found, priced(np.array(s)), key=lambda x: x[0])
        size += 1
    return found[1]


def _viterbi(costs: np.ndarray, switch: float) -> np.ndarray:
    n, k = costs.shape
    back = np.empty((n, k), np.int64)
    score = costs[0]
    for i in range(1, n):
        j = int(score.argmin())
        change = score[j] + switch
        stay = score <= change
        back[i] = np.where(stay, np.arange(k), j)
        score = np.where(stay, score, change) + costs[i]
    path = np.empty(n, np.int64)
    path[-1] = score.argmin()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def romanise(text: str, lang: str) -> str | None:
    """The text in Latin letters, for languages that are also written so."""
    if lang == "ru":
        return "".join(L.CYRILLIC_LATIN.get(c, c) for c in text.lower())
    if lang != "hi":
        return None
    out: list[str] = []
    s = unicodedata.normalize("NFD", text).replace("़", "")
    for i, c in enumerate(s):
        nxt = s[i + 1] if i + 1 < len(s) else " "
        if c in L.DEVANAGARI_CONSONANTS:
            out.append(L.DEVANAGARI_CONSONANTS[c])
            if nxt not in L.DEVANAGARI_SIGNS and nxt != "्" and unicodedata.category(nxt)[0] in "LM" or nxt in "ंँः":
                out.append("a")
        else:
            out.append(L.DEVANAGARI_VOWELS.get(c) or L.DEVANAGARI_SIGNS.get(c) or ("" if c == "्" else c))
    return "".join(out)


def confidence(costs: np.ndarray, n_bytes: int, fit: Fit = Fit()) -> float:
    """Confidence from 0 to 1 in the cheapest language of a stretch of n_bytes letters with these code lengths.

    Bytes of a text aren't independent, so the odds come from the lead over the second language in
    fit.odds_bytes bytes, not in all of them; text that the best model can't write shorter than the bytes
    themselves (8 bits each) is trusted in proportion.
    """
    two = np.sort(costs)[:2]
    n = max(1, n_bytes)
    lead = float(two[1] - two[0]) * fit.odds_bytes / max(n, fit.odds_bytes) if len(two) > 1 else 64.0
    return min(1.0, 8.0 * n / max(1.0, float(two[0]))) / (1.0 + 2.0 ** -min(64.0, lead))


def training_texts(jobs: DataFrame, texts: list[tuple[DataFrame, str, str]], fit: Fit = Fit()) -> dict[str, list[bytes]]:
    """A bounded sample of sentences by language, as the models read them.

    `texts` are (table with ep and idx, text column, job column of its language). Of each language about
    fit.episodes episodes are drawn by a hash, of each of those the first fit.rows rows, and fit.bytes_each
    bytes are kept; so at most 13 * fit.episodes * fit.rows rows of a table reach the driver.
    """
    spark = jobs.sparkSession
    roles = sorted({t[2] for t in texts})
    named = jobs.select("ep", F.inline(F.array(*[F.struct(F.lit(c).alias("role"), F.lower(F.trim(c)).alias("lang")) for c in roles])))
    named = named.where(F.col("lang").isin(*L.LANGUAGE_NAMES) & F.col("ep").isNotNull())
    counts = named.groupBy("role", "lang").count().collect()  # a row for each role and language
    rates = spark.createDataFrame([(r["role"], r["lang"], fit.episodes / r["count"]) for r in counts], "role string, lang string, rate double")
    chance = F.pmod(F.xxhash64("ep", F.lit(fit.seed)), F.lit(1_000_000)) / 1_000_000
    chosen = named.join(F.broadcast(rates), ["role", "lang"]).where(chance < F.col("rate")).select("role", "ep", "lang").distinct().collect()
    samples: dict[str, list[bytes]] = {}
    for df, column, role in texts:
        # about 13 * fit.episodes chosen episodes are small enough to broadcast
        eps = spark.createDataFrame([(r["ep"], r["lang"]) for r in chosen if r["role"] == role], "ep bigint, lang string")
        rows = df.where((F.col("idx") < fit.rows) & F.length(column).between(1, fit.longest)).select("ep", F.col(column).alias("text"))
        for r in rows.join(F.broadcast(eps), "ep").select("lang", "text").collect():
            room = samples.setdefault(r["lang"], [])
            for s, e in spans(r["text"]):
                room.append(plain(r["text"][s:e]))
                other = romanise(r["text"][s:e], r["lang"])
                if other:
                    room.append(plain(other))
    for g, rows in samples.items():
        kept, size = [], 0
        rows.sort()
        random.Random(fit.seed).shuffle(rows)
        for t in rows:
            if size > fit.bytes_each:
                break
            kept.append(t)
            size += len(t)
        samples[g] = kept
    return samples


def slices(batches: Iterator[pd.DataFrame], chars: int) -> Iterator[pd.DataFrame]:
    """The rows of the batches in slices of about `chars` characters of their text, at least one row each."""
    for pdf in batches:
        if not len(pdf):
            continue
        at = np.cumsum([len(t) for t in pdf["text"]]) // chars
        starts = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1, [len(pdf)]])
        for a, b in zip(starts, starts[1:], strict=False):
            yield pdf.iloc[a:b].reset_index(drop=True)


def identify(docs: DataFrame, models: ByteModels, fit: Fit = Fit()) -> DataFrame:
    """Segments of every document with letters.

    `docs` has doc_id, text and lang. Returns doc_id, label (the code `lang` names, '' for a language the
    models don't know, null for none), seg_no, n_segments, char_start, char_end, lang ('und': none of the models'),
    confidence. A document in one language has one segment from offset 0. Null, empty and letterless texts give no rows.
    """
    given = share(docs.sparkSession, models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared(given)
        for pdf in slices(batches, fit.slice_chars):
            parts, owner, plains = [], [], []
            for r, t in enumerate(pdf["text"]):
                for s, e in _parts(t):
                    parts.append((s, e))
                    owner.append(r)
                    plains.append(plain(t[s:e]))
            costs = m.score(plains)
            bounds = np.searchsorted(np.array(owner, np.int64), np.arange(len(pdf) + 1))
            out = []
            for r, t in enumerate(pdf["text"]):
                a, b = bounds[r], bounds[r + 1]
                if a == b:
                    continue
                path = best_path(costs[a:b], fit.switch_bits, fit.known_bits)
                cuts = [0, *(np.nonzero(path[1:] != path[:-1])[0] + 1), b - a]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    total = costs[a + i : a + j].sum(0)
                    size = sum(map(len, plains[a + i : a + j]))
                    conf = confidence(total, size, fit)
                    strange = size >= fit.strange_bytes and total[path[i]] >= fit.strange_bits * size
                    start = parts[a + i][0] if len(cuts) > 2 else 0
                    end = parts[a + j - 1][1] if len(cuts) > 2 else len(t)
                    out.append((r, k, len(cuts) - 1, start, end, UNKNOWN if strange else m.langs[path[i]], conf))
            rows = [o[0] for o in out]
            got = pd.DataFrame([o[1:] for o in out], columns=["seg_no", "n_segments", "char_start", "char_end", "lang", "confidence"])
            got = got.astype({"seg_no": "int32", "n_segments": "int32", "char_start": "int32", "char_end": "int32", "lang": "object", "confidence": "float64"})
            labels = pd.Series([label_code(x) for x in pdf["lang"].iloc[rows]], dtype=object)
            yield pd.concat([pdf[["doc_id"]].iloc[rows].reset_index(drop=True), labels.rename("label"), got], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text", "lang").where(F.col("text").rlike(r"\p{L}"))
    schema = f"doc_id {kind}, label string, seg_no int, n_segments int, char_start int, char_end int, lang string, confidence double"
    return base.mapInPandas(run, schema)


def label_defects(segments: DataFrame) -> DataFrame:
    """(doc_id, defect, seg_no, char_start, lang, confidence) of mixed, missing and wrong labels.

    A document in no known language is missing its label if it has none; a label for another language outside
    the models is not wrong.
    """
    agrees = (F.col("label") == "") & (F.col("lang") == UNKNOWN)
    return segments.withColumn(
        "defect",
        F.when(F.col("n_segments") > 1, "mixed").when(F.col("label").isNull(), "missing").when((F.col("label") != F.col("lang")) & ~agrees, "wrong"),
    ).where("defect is not null")
