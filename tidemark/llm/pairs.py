"""Defective pairs of a source and its translation.

The first defect that applies is given: empty, refusal, copied, wrong_language or truncated.

* empty and refusal use word lists;
* copied compresses the target with the source as a zstandard dictionary: a target that costs
  little beside its source repeats it; what language dictionaries know of the words then tells copies
  from names, numbers and words that both languages share;
* wrong_language compares dictionary scores of the target's words under all languages, and code lengths: a
  target of which the dictionaries know little, and which its language's byte model can't even write in
  its plain bytes, is in another language, known to the models or not;
* truncated models terminal contexts: how a complete text of a language may end (marks, and the last words or
  letters with how often they end a sentence of the sample), open quotations and brackets, and the number of
  sentences on both sides.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import add

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lexicon as L
from tidemark.llm.langid import DOTTED, only, plain
from tidemark.llm.ppm import ByteModels
from tidemark.llm.sentences import _token, spans
from tidemark.session import share, shared

_LETTER = regex.compile(r"[\p{L}\p{N}]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_ASCII_WORD = re.compile("[a-z0-9]+")
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]+")
_PLAIN = regex.compile(r"[^\p{L}\p{N}]+")
_KEPT = regex.compile(r"[\p{L}\p{N}]+")
_PLAIN_MARKS = regex.compile(r"[^\p{L}\p{M}]+")
#: Any letter of a script without spaces stands here.
_MAY_DENSE = re.compile("[\u0e00-\U0010ffff]")
#: Marks at the end of a text that is meant to go on.
_GOES_ON = re.compile("[,，、;；…‥—–-]|\\.\\.")
#: Languages whose sentences need no end mark.
UNMARKED = ("th",)
#: A quick look for what any refusal holds; the patterns of whole refusals are slow.
_STEM = re.compile("|".join(f"{re.escape(c)}(?:{'|'.join(re.escape(s[1:]) for s in L.REFUSAL_STEMS if s[0] == c)})" for c in dict.fromkeys(s[0] for s in L.REFUSAL_STEMS)))
_REFUSAL = regex.compile("|".join(L.REFUSALS), regex.I)
_ADDRESS = regex.compile(r"\S*[\p{Latin}\d]\.[\p{Latin}]{3,}[\p{Latin}/.]*")
_QUOTE_MARK = re.compile("[“„«「\"]")
_QUOTE = regex.compile(r"“[^“”]{1,400}”|„[^„“”]{1,400}[“”]|«[^«»]{1,400}»|「[^「」]{1,400}」|\"[^\"\n]{1,400}\"")
#: One to three capitalised words without an end mark: a name, which reads the same everywhere, unless the dictionaries know them.
_NAME = regex.compile(r"\p{Lu}[\p{Latin}\p{Cyrillic}'’-]+(?:\s+\p{Lu}[\p{Latin}\p{Cyrillic}.'’-]*){0,2}")
_CLOSERS = "”»」』\"“)）]】’'"


def words(text: str) -> list[str]:
    """Dictionary entries of a text: words, and character pairs of scripts without spaces."""
    out = []
    if "." in text and DOTTED.search(text):
        text = _ADDRESS.sub(" ", text)
    if text.isascii():
        return [w for w in _ASCII_WORD.findall(text.lower()) if not w.isdigit() and w not in L.SHARED_WORDS]
    dense = _MAY_DENSE.search(text) is not None and _DENSE.search(text) is not None
    for w in _WORD.findall(text.lower()):
        if not dense or not _DENSE.search(w):
            out.append(w)
            continue
        if len(w) > 1 and _DENSE.fullmatch(w):
            out.extend(map(add, w, w[1:]))
            continue
        for run in _DENSE.findall(w):
            out.extend(run[i : i + 2] for i in range(len(run) - 1)) if len(run) > 1 else out.append(run)
        out.extend(x for x in _DENSE.split(w) if x)
    return [w for w in out if not w.isdigit() and w not in L.SHARED_WORDS]


def terminal_contexts(texts: list[str]) -> dict[str, tuple[int, int, int]]:
    """Of each context of 6 to 8 characters: how often it went on, the most often in one way, and how often
    it ended its text."""
    seen: dict[str, Counter] = {}
    for t in texts:
        s = "".join(t.split())
        for i in range(6, len(s) + 1):
            for k in range(6, min(8, i) + 1):
                seen.setdefault(s[i - k : i], Counter())[s[i : i + 1]] += 1
    out = {}
    for c, n in seen.items():
        ended = n.pop("", 0)
        out[c] = (sum(n.values()), max(n.values(), default=0), ended)
    return out


def breaks_off(text: str, seen: dict[str, tuple[int, int, int]]) -> bool:
    """Whether the text ends in a vowel that is written before its consonant, or the longest
    well-known context at its end can't end a sentence: inside a word only one character follows, and
    between words many do but an end almost never does."""
    s = _PLAIN_MARKS.sub("", text)
    if s[-1:] in L.LEADING_VOWELS:
        return True
    for k in range(min(8, len(s)), 5, -1):
        went, same, ended = seen.get(s[-k:], (0, 0, 0))
        if went + ended >= 5:
            return not ended and same >= 0.9 * went or went >= 40 and ended < 0.01 * went
    return False


#: How often a context must have ended a text to count.
LEAST_CLOSINGS = 5


def _closing(text: str) -> str:
    """The context at the end of a normalised text: its last two words, or four letters of a script without spaces."""
    ws = text.split()
    return "".join(ws)[-4:] if ws and _DENSE.search(ws[-1]) else " ".join(ws[-2:])


def ends_dense(text: str) -> bool:
    """Whether the last word of a normalised text has letters of a script without spaces."""
    last = text.rpartition(" ")[2]
    return not last.isascii() and _MAY_DENSE.search(last) is not None and _DENSE.search(last) is not None


def closing_counts(texts: list[str]) -> tuple[Counter, Counter]:
    """How often each context stands in the texts, and how often it ends its text."""
    seen: Counter = Counter()
    for t in texts:
        ws = t.split()
        if ws and _DENSE.search(ws[-1]):
            run = "".join(ws)
            seen.update(run[i - 4 : i] for i in range(4, len(run) + 1))
        else:
            seen.update(" ".join(ws[i - 1 : i + 1]) for i in range(1, len(ws)))
    return seen, Counter(map(_closing, texts))


def closing_contexts(texts: list[str], least: int = LEAST_CLOSINGS) -> dict[str, float]:
    """Contexts seen at least `least` times and the share of those that ended their text, where it passes one half."""
    seen, ended = closing_counts(texts)
    return {c: n / seen[c] for c, n in ended.items() if n >= least and 2 * n > seen[c] > 0}


#: How often a language must have used a word to know it, and in how many bytes of its text; fewer bytes count as so many.
LEAST_WORDS, FIT_BYTES = 3, 120_000


@dataclass
class Dictionaries:
    """Words of each language with log relative frequencies, from labelled texts."""

    langs: list[str]
    #: row of each word in `table`
    rows: dict[str, int]
    #: log relative frequency by row and language, `floor` where a language lacks the word
    table: np.ndarray
    floor: float
    #: mean characters of a sentence
    length: dict[str, float]
    #: of a language without end marks: what follows a context of 6 to 8 characters
    ends: dict[str, dict[str, tuple[int, int, int]]]
    #: of every language: contexts that mostly end their sentence
    closings: dict[str, dict[str, float]]

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], least: int = LEAST_WORDS) -> Dictionaries:
        words_of, length, ends, closings = {}, {}, {}, {}
        for g in samples:
            texts = [t.decode() for t in samples[g] if t]
            length[g] = sum(map(len, texts)) / max(1, len(texts))
            closings[g] = closing_contexts(texts)
            if g in UNMARKED:
                ends[g] = terminal_contexts(texts)
            counts = Counter(w for t in samples[g] for w in words(t.decode()))
            words_of[g] = {w: n for w, n in counts.items() if n >= least}, sum(counts.values()), least
        return cls.from_counts(words_of, length, ends, closings)

    @classmethod
    def from_counts(
        cls, words_of: dict[str, tuple[dict[str, int], int, float]], length: dict[str, float], ends: dict[str, dict[str, tuple[int, int, int]]], closings: dict[str, dict[str, float]]
    ) -> Dictionaries:
        """Dictionaries from the words each language knows, with their counts, the number of all its words and the least count of a known one."""
        langs = sorted(words_of)
        log: dict[str, dict[int, float]] = {}
        lows = []
        for j, g in enumerate(langs):
            counts, total, least = words_of[g][0], words_of[g][1] + 1, words_of[g][2]
            # an unknown word has a sixth of the least count: half a word where that is 3
            lows.append(math.log(least / 6 / total))
            for w, n in counts.items():
                log.setdefault(w, {})[j] = math.log(n / total)
        floor = min(lows, default=-12.0) - 1
        table = np.full((len(log), len(langs)), floor)
        for r, row in enumerate(log.values()):
            for j, v in row.items():
                table[r, j] = v
        return cls(langs, {w: r for r, w in enumerate(log)}, table, floor, length, ends, closings)

    def found(self, ws: list[str]) -> list[int]:
        """Rows of the words that any dictionary holds."""
        return [r for r in map(self.rows.get, ws) if r is not None]

    @cached_property
    def own(self) -> dict[str, set[str]]:
        """The words of each language."""
        return {g: {w for w, r in self.rows.items() if self.table[r, j] > self.floor} for j, g in enumerate(self.langs)}

    def knows(self, ws: list[str], lang: str) -> np.ndarray:
        """Which of the found words the language has."""
        if lang not in self.langs:
            return np.zeros(len(self.found(ws)), bool)
        return self.table[self.found(ws), self.langs.index(lang)] > self.floor


def is_empty(source: str | None, target: str | None) -> bool:
    if target is None:
        return True
    if not source or not source[0].isalpha() and not _LETTER.search(source):
        return False
    if not target or not target[0].isalpha() and not _LETTER.search(target):
        return True
    t = target.strip().lower().strip("[](){}<>「」【】\"'`*_-–—.:!/\\ ")
    return (t in L.PLACEHOLDERS or t.replace("_", " ") in L.PLACEHOLDERS) and t != source.strip().lower().strip(".!?\"' ")


def is_refusal(source: str, target: str) -> bool:
    if _STEM.search(target.casefold()) is None:
        return False
    return _REFUSAL.search(target) is not None and _REFUSAL.search(source) is None


#: Bytes of a normalised target from which compression sees a copy.
COPY_BYTES = 12
#: Bytes a byte that a copy costs at most beside its source, and that equal texts cost.
COPY_SHARE, EQUAL_SHARE = 0.35, 0.5
#: Bits a byte of a text that its language's model can't write shorter than the bytes themselves, and one more.
STRANGE_BITS = 9.0
#: Bytes of the letters of a target from which code lengths a byte count.
STRANGE_BYTES = 24


def copy_cost(source: str, target: str) -> float:
    """Bytes a byte that the target costs with the source as dictionary, less the cost of an empty text."""
    d = zstandard.ZstdCompressionDict(source.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    raw = target.encode()
    return max(0, len(c.compress(raw)) - 9) / max(1, len(raw))


def bare(texts: list[str | None]) -> list[str]:
    """Letters and digits of each text, in one case."""
    return only([(t or "").replace("\n", " ") for t in texts], _KEPT, False).casefold().split("\n")


def is_copied(source: str, target: str, src_lang: str, tgt_lang: str, dicts: Dictionaries, letters: tuple[str, str] | None = None) -> bool:
    """`letters` are those of source and target, if they are known (`bare`)."""
    a, b = letters or (_PLAIN.sub("", source).casefold(), _PLAIN.sub("", target).casefold())
    if not a or not b or not _near(a, b) and not (len(a) >= 2 and a in b and _only_framed(a, b, target)):
        return False
    return _foreign(source, src_lang, tgt_lang, dicts)


def _near(a: str, b: str) -> bool:
    """Whether compression and character runs show the target in the source."""
    if a != b and _unlike(a, b):
        return False
    # below COPY_BYTES compression can't see a copy; equal or framed texts are compared as they are
    near = copy_cost(a, b) <= (EQUAL_SHARE if a == b else COPY_SHARE) if len(b.encode()) >= COPY_BYTES else a == b
    return near and (a == b or _covers(a, b))


#: Characters of a target whose first runs are looked up one by one; in longer texts compression is cheaper.
LOOKED_UP = 200


def _run_length(text: str) -> int:
    return 2 if not text.isascii() and _MAY_DENSE.search(text) and _DENSE.search(text) else 4


def _unlike(a: str, b: str) -> bool:
    """Whether the first runs of a short target already miss more often in the source than `_covers` allows."""
    if max(len(a), len(b)) > LOOKED_UP:
        return False
    k = _run_length(a)
    n = len(b) - k + 1
    room, missed = max(12, 0.15 * n), set()
    for i in range(n):
        run = b[i : i + k]
        if run not in a:
            missed.add(run)
            if len(missed) > room:
                return True
    return False


def _only_framed(a: str, b: str, target: str) -> bool:
    """Whether nothing but frames stands beside the repetitions of the source."""
    if not b.replace(a, ""):
        return True
    return all(w in L.FRAMES or w in a for w in _WORD.findall(target.casefold()))


def _covers(a: str, b: str) -> bool:
    """Whether nearly all of the target stands in the source and the target holds most of the source."""
    k = _run_length(a)
    have = {a[i : i + k] for i in range(len(a) - k + 1)}
    got = {b[i : i + k] for i in range(len(b) - k + 1)}
    if not have or not got:
        return False
    both = len(have & got)
    return len(got) - both <= max(12, 0.15 * len(got)) and both >= 0.5 * len(have)


def _foreign(source: str, src_lang: str, tgt_lang: str, dicts: Dictionaries) -> bool:
    """Whether the words belong to the source's language rather than to both languages or to none."""
    ws = words(source)
    have = dicts.knows(ws, src_lang)
    src, both = int(have.sum()), int((have & dicts.knows(ws, tgt_lang)).sum())
    if not src:
        return False
    return both < src if len(ws) <= 3 else src - both >= max(2, 0.25 * src)


def language_doubt(target: str, tgt_lang: str, dicts: Dictionaries) -> str | None:
    """What speaks against the target's language: 'vote' where dictionary words are for another one, 'unknown' where
    the language's dictionary holds less than half of the words, else None."""
    if tgt_lang not in dicts.langs:
        return None
    ws = words(_QUOTE.sub(" ", target) if _QUOTE_MARK.search(target) else target) or words(target)
    if not ws:
        return None
    own = dicts.own[tgt_lang]
    known_here = sum(map(own.__contains__, ws))
    if known_here == sum(map(dicts.rows.__contains__, ws)):  # no other language knows more
        return "unknown" if 2 * known_here < len(ws) else None
    found = dicts.found(ws)
    mine = dicts.langs.index(tgt_lang)
    table = dicts.table[found]
    known = table > dicts.floor
    if found:
        scores = table.sum(0)
        best = int(scores.argmax())
        if best != mine and scores[best] - scores[mine] >= 3.0 and known[:, best].sum() > known[:, mine].sum():
            return "vote"
    return "unknown" if 2 * int(known[:, mine].sum()) < len(ws) else None


def is_wrong_language(doubt: str | None, own_bits: float, margin: float, n_bytes: int) -> bool:
    """Whether code lengths confirm a doubt: 8 bits more than the best model's, or more bits than the bytes have."""
    if doubt == "vote" and margin >= 8.0:
        return True
    return doubt is not None and n_bytes >= STRANGE_BYTES and own_bits >= STRANGE_BITS * n_bytes


def tail_of(text: str) -> str:
    """The marks and blanks after the last letter or digit."""
    i = len(text)
    while i and not (text[i - 1].isalnum() or not text[i - 1].isascii() and unicodedata.category(text[i - 1])[0] == "M"):
        i -= 1
    return text[i:]


def ends_open(text: str) -> bool:
    """Whether a text breaks off: no end mark, an abbreviation, or an open quotation or bracket at its end."""
    t = text.rstrip()
    while t and t[-1] in _CLOSERS:
        t = t[:-1].rstrip()
    if not t or t[-1] not in L.TERMINAL:
        return True
    if t[-1] in "…‥" or t.endswith(".."):
        return True
    for o, c in (("“", "”"), ("«", "»"), ("「", "」"), ("(", ")"), ("（", "）")):
        if o in text and text.count(o) > text.count(c) and (o != "“" or "„" not in text):
            return True
    if "„" in text and text.count("„") > text.count("“") + text.count("”"):
        return True
    if text.count('"') % 2:
        return True
    if t[-1] == ".":
        word = _token(t, max(0, len(t) - 40), len(t) - 1, t[-2:-1].isascii())
        last = word.lower().rpartition(".")[2]
        if last in L.TITLES and last not in ("s", "m") or word.lower() in L.INSIDE or last in L.BEFORE_NUMBER and last != "no" and len(last) < 4:
            return True
        if len(word) == 1 and word.isupper() and word != "A":
            return True
    return False


def is_truncated(source: str, target: str, src_lang: str, tgt_lang: str, dicts: Dictionaries) -> bool:
    if _GOES_ON.search(tail_of(source)):
        return False
    if src_lang not in UNMARKED and ends_open(source):
        return False
    whole = len(spans(source))
    if whole > 1 and len(spans(target)) < whole:
        return True
    if tgt_lang not in UNMARKED:
        return ends_open(target) and not _complete_unmarked(source, target, src_lang, tgt_lang, dicts)
    if _GOES_ON.search(tail_of(target)):
        return True
    if breaks_off(target, dicts.ends.get(tgt_lang, {})):
        return True
    return 0.0 < _relative_length(source, target, src_lang, tgt_lang, dicts) < 0.5


def _relative_length(source: str, target: str, src_lang: str, tgt_lang: str, dicts: Dictionaries) -> float:
    """Length of the target in mean sentences of its language, as a share of the source's; 0 where one is unknown."""
    a, b = dicts.length.get(src_lang), dicts.length.get(tgt_lang)
    return (len(target) / b) / (len(source) / a) if a and b and source else 0.0


def _complete_unmarked(source: str, target: str, src_lang: str, tgt_lang: str, dicts: Dictionaries) -> bool:
    """Whether a target without an end mark is complete: its last words mostly end their sentence, and it is not
    short for its source. An ellipsis or an open quotation or bracket is never complete."""
    if not target.rstrip()[-1:].isalnum() or ends_open(target.rstrip() + "."):
        return False
    share = dicts.closings.get(tgt_lang, {}).get(_closing(plain(target).decode()), 0.0)
    return share > 0.5 and _relative_length(source, target, src_lang, tgt_lang, dicts) > 0.8


def early_defect(source: str | None, target: str | None, src_lang: str, tgt_lang: str, dicts: Dictionaries, letters: tuple[str, str] | None = None) -> tuple[str | None, bool]:
    """(empty, refusal or copied where one applies, whether the later types are still open)."""
    if is_empty(source, target):
        return "empty", False
    if not source or not target or not _LETTER.search(target):
        return None, False
    if is_refusal(source, target):
        return "refusal", False
    if source.strip() == target.strip() and _NAME.fullmatch(source.strip()) and not _foreign(source, src_lang, tgt_lang, dicts):
        return None, False
    if is_copied(source, target, src_lang, tgt_lang, dicts, letters):
        return "copied", False
    return None, True


def defects(pairs: list[tuple[str | None, str | None, str, str]], dicts: Dictionaries, models: ByteModels) -> list[str | None]:
    """The first defect of each pair (source, target, source language, target language), or None.

    Targets whose language is in doubt are scored by the byte models together.
    """
    out: list[str | None] = []
    open_, doubts = [], []
    letters = zip(bare([p[0] for p in pairs]), bare([p[1] for p in pairs]), strict=True)
    for i, ((source, target, a, b), both) in enumerate(zip(pairs, letters, strict=False)):
        found, more = early_defect(source, target, a, b, dicts, both)
        out.append(found)
        if more:
            open_.append(i)
            doubt = language_doubt(target, b, dicts) if b in models.langs else None
            if doubt:
                doubts.append((i, doubt, plain(target)))
    wrong = set()
    if doubts:
        bits = models.score([d[2] for d in doubts])
        for (i, doubt, letters), row in zip(doubts, bits, strict=True):
            own = float(row[models.langs.index(pairs[i][3])])
            if is_wrong_language(doubt, own, own - float(row.min()), len(letters)):
                wrong.add(i)
    for i in open_:
        source, target, a, b = pairs[i]
        out[i] = "wrong_language" if i in wrong else "truncated" if is_truncated(source, target, a, b, dicts) else None
    return out


def find_defects(pairs: DataFrame, models: tuple[Dictionaries, ByteModels], keys: list[str]) -> DataFrame:
    """Rows (keys, defect) of the defective pairs.

    `pairs` has the keys and source_text, target_text, source_lang, target_lang. Languages are two-letter
    codes in lower case; a null or unknown one turns off the checks that need it. Repeated rows give
    repeated results.
    """
    given = share(pairs.sparkSession, models)
    base = pairs.select(*keys, "source_text", "target_text", F.coalesce("source_lang", F.lit("")).alias("_s"), F.coalesce("target_lang", F.lit("")).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dicts, byte_models = shared(given)
        for pdf in batches:
            found = defects(list(zip(pdf["source_text"], pdf["target_text"], pdf["_s"], pdf["_t"], strict=True)), dicts, byte_models)
            hit = [i for i, d in enumerate(found) if d]
            yield pdf[keys].iloc[hit].assign(defect=pd.Series([found[i] for i in hit], dtype=object).to_numpy())

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in keys)
    return base.mapInPandas(run, schema + ", defect string")
