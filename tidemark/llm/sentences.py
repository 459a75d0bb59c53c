"""Sentence boundaries across languages and scripts.

Every text becomes a lattice of the places where a sentence could end: end marks, blank lines, list numbers,
blanks, and gaps without a mark. An edge leads from one place to the next and either ends the sentence there
or goes on; a quotation or bracket is an edge over all that stands inside it, beside the edge on which its
mark stands alone. Each edge has a score in log odds, and the path with the best sum gives the sentences
(`_best_cuts`: Viterbi, with at most `BEAM` open sentences of different starts in one place).

* Spaced scripts score an end mark by what stands around it (`dot_gain`: abbreviation, number, list number,
  initial, case of the next word, opening words).
* Scripts without spaces are segmented by a word lattice first (`Words`): the cheapest path of dictionary
  words over the whole run around a gap. A gap that a word crosses is none; otherwise the word before it (a
  final particle, or one that can't end a sentence) and the word after it (an opening word, or one that
  can't open one) are scored, with what the gap is: a blank, a line break, which only wraps, or nothing.
* A blank in Thai text ends a sentence unless digits, Latin letters or full stops are beside it; Thai words
  are looked up in the same lattice.

The dictionary holds the fixed particles and opening words and the words of a public vocabulary
(`load_words`). No language label is needed: the rules go by the letters next to a mark. Null and blank texts
have no sentences. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lexicon as L
from tidemark.session import share, shared

#: Public vocabulary whose words join the dictionary; a missing file leaves the fixed words.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Open sentences of different starts that are kept in one place of the lattice.
BEAM = 8
#: Log odds from which one of two edges is not followed any more.
SURE = 4.0
#: Log odds of a gap between spaceless letters by what it is.
GAP = {"blank": 2.0, "break": -4.5, "none": -5.0, "thai": 6.0}

# --- fixed values: paired marks
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "《": "》"}
BRACKETS = {"(": ")", "[": "]", "（": "）", "【": "】", "{": "}", "［": "］"}
CLOSERS = "”»」』›》\"“)）]】}］’"
HARD = "!?。！？؟।॥｡！？"
DOTS = ".…‥"

_EVENT = regex.compile(
    r"(?P<t>[!?。！？؟।॥｡.…‥]+)|(?P<q>[“„«「『‹《\"])|(?P<b>[(\[（【{［])|(?P<n>\n[^\S\n]*\n\s*)|(?P<l>\n[^\S\n]*(?=(?P<k>\d{1,3})[.)．、]))"
)
_THAI_EVENT = regex.compile(
    r"(?P<t>[!?。！？؟।॥｡.…‥]+)|(?P<q>[“„«「『‹《\"])|(?P<b>[(\[（【{［])|(?P<n>\n[^\S\n]*\n\s*)|(?P<l>\n[^\S\n]*(?=(?P<k>\d{1,3})[.)．、]))|(?P<w>\s+)"
)
_SPEAKER = regex.compile(r"(?:\[[^\]\n]*\]\s*)?\p{Lu}\p{Latin}*(?: \p{Lu}\p{Latin}*)?[:：]")
# --- fixed values: German words before an ordinal number
_BEFORE_ORDINAL = frozenset("am vom zum den der dem die das bis ab seit im jeden".split())
_THAI = re.compile("[\u0e01-\u0e3a\u0e40-\u0e5b]")
_WIDE = re.compile("[\u3000-\U0010ffff]")
_BARE = regex.compile(r"[\p{L}\p{N}]")
_LIST_START = regex.compile(r"\s*1[.)．、]")
_BLANK = re.compile(r"\s")
_GAP_NEIGHBOUR = regex.compile(r"[\p{Nd}\p{Latin}.]")
_SPACELESS_GAP = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}ー])\s+(?=[\p{Han}\p{Hiragana}\p{Katakana}])")
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]+")
_KATAKANA = regex.compile(r"[\p{Katakana}ー]")
_RUN_BEFORE = regex.compile(r"(?r)[\p{Han}\p{Hiragana}\p{Katakana}ー]+")
_UNMARKED = regex.compile(
    "(?:%s)()(?=%s)" % ("|".join(w for x, g in L.FINAL_WORDS if x > 1 for w in g.split() if w[0] > "\u2fff"), "|".join(w for x, g in L.OPENING_WORDS if x > 1 for w in g.split() if w[0] > "\u2fff"))
)


@dataclass
class Words:
    """Dictionary of the scripts without spaces: costs of words, and what particles and opening words say of a gap."""

    costs: dict[str, float] = field(default_factory=dict)
    #: log odds that a sentence ends after the word, and that one begins before it
    ends: dict[str, float] = field(default_factory=dict)
    opens: dict[str, float] = field(default_factory=dict)
    longest: int = 1

    @classmethod
    def of(cls, ranked: dict[str, int]) -> Words:
        """The fixed words, and `ranked` ones with costs by rank (a frequent word is cheap)."""
        w = cls()
        for word, rank in ranked.items():
            w.costs[word] = 4.0 + math.log2(2 + rank) / 2
        for table, known in ((L.OPENING_WORDS, w.opens), (L.FINAL_WORDS, w.ends)):
            for score, group in table:
                for word in group.split():
                    known[word] = score
                    w.costs.setdefault(word, 7.0)
        for word, score in w.opens.items():
            if score >= 2.0:  # a connective waits for its sentence
                w.ends.setdefault(word, -5.0)
        w.longest = max(map(len, w.costs), default=1)
        return w

    def path(self, run: str) -> list[int]:
        """Ends of the words on the cheapest path over a run of letters; a letter that no word holds costs 10."""
        n = len(run)
        cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            c = cost[i]
            if c + 10.0 < cost[i + 1]:
                cost[i + 1], back[i + 1] = c + 10.0, i
            for j in range(i + 1, min(n, i + self.longest) + 1):
                w = self.costs.get(run[i:j])
                if w is not None and c + w < cost[j]:
                    cost[j], back[j] = c + w, i
        out, j = [], n
        while j:
            out.append(j)
            j = back[j]
        return out[::-1]

    def gain(self, left: str, right: str, kind: str) -> float:
        """Log odds that a sentence ends between two runs of spaceless letters."""
        ends = self.path(left + right)
        at = bisect_left(ends, len(left))
        if at == len(ends) or ends[at] != len(left):
            return -SURE - 1  # a word crosses the gap
        before = left[ends[at - 1] if at else 0 :]
        after = right[: ends[at + 1] - len(left)] if at + 1 < len(ends) else right
        score = GAP[kind] + self._known(self.ends, left, before, True) + self._known(self.opens, right, after, False)
        if _KATAKANA.fullmatch(left[-1]) and _KATAKANA.fullmatch(right[0]):
            score -= 3.0  # parts of one name
        return score - 3.0 * (min(len(left), len(right)) < 3)

    @staticmethod
    def _known(table: dict[str, float], run: str, word: str, at_end: bool) -> float:
        """Score of the word beside the gap; joined words (まし|た, 我|们) count as the longest listed one."""
        for k in range(min(6, len(run)), len(word) - 1, -1):
            got = table.get(run[-k:] if at_end else run[:k])
            if got is not None:
                return got
        return 0.0


@lru_cache(maxsize=4)
def load_words(vocabulary: str = VOCABULARY) -> Words:
    """The dictionary with the words of a byte-level vocabulary file that are written in spaceless scripts."""
    ranked: dict[str, int] = {}
    if Path(vocabulary).is_file():
        for line in Path(vocabulary).read_bytes().splitlines():
            token, rank = line.split()
            try:
                word = base64.b64decode(token).decode()
            except UnicodeDecodeError:
                continue
            if len(word) > 1 and _SPACELESS.fullmatch(word):
                ranked[word] = int(rank)
    return Words.of(ranked)


_FIXED_WORDS = Words.of({})


def _is_thai(text: str) -> bool:
    if text.isascii() or _THAI.search(text) is None:
        return False
    letters = len(_THAI.findall(text))
    return 2 * letters > sum(map(str.isalpha, text))


def _skip(text: str, i: int) -> int:
    n = len(text)
    while i < n and text[i].isspace():
        i += 1
    return i


def _token(text: str, lo: int, hi: int, latin: bool = False) -> str:
    """The run of letters, marks, digits, full stops, apostrophes and hyphens that ends at hi."""
    word = text[lo:hi].rpartition(" ")[2]
    if word.isalnum() and (not latin or word.isascii()):
        return word  # nearly every word
    i = hi
    while i > lo:
        c = text[i - 1]
        if not (c.isalnum() or c in ".'’-" or not c.isascii() and unicodedata.category(c)[0] == "M"):
            break
        if latin and ord(c) > 0x24F and c != "’":
            break
        i -= 1
    return text[i:hi]


_SECOND = {b for _, b in L.INSIDE_PAIRS}


def dot_gain(text: str, dot: int, sent_start: int) -> float:
    """Log odds that the single full stop at `dot` ends the sentence that began at `sent_start`."""
    n, after = len(text), dot + 1
    nxt = _skip(text, after)
    if nxt >= n:
        return 8.0
    c = text[nxt]
    gap = nxt > after
    p = text[dot - 1] if dot else ""
    tok = _token(text, max(sent_start, dot - 40), dot, p.isascii())
    if not gap:
        if not (c.isalpha() or c in "¿¡"):
            return -6.0
        # a missing blank: ...word.Next
        last = tok.rpartition(".")[2]
        if len(last) < 2 or not last[-1].isalpha():
            return -5.0
        if c in "¿¡":
            return 5.0
        if c.isupper():
            return 3.0 if last[-1].islower() and last.lower() not in L.TITLES and last.lower() not in L.INSIDE else -3.0
        if "가" <= p <= "힣" and "가" <= c <= "힣":
            return 4.0
        if "؀" <= p <= "ۿ" and "؀" <= c <= "ۿ":
            return 3.0 if "." not in tok and last not in L.TITLES and len(last) > 2 else -3.0
        return -5.0
    if c.islower() or c in ",;:،、，؛—–)]}…":
        return -6.0
    low = tok.lower()
    last = low.rpartition(".")[2]
    head = dot - len(tok)
    prev = ""  # the word before, where a rule below asks for it
    if tok.isdigit() or len(last) == 1 or last in _SECOND or "؀" <= p <= "ۿ":
        prev = _token(text, max(sent_start, dot - 60), _rstrip(text, sent_start, head)).rstrip(".").lower()
    numbered = prev.rpartition(".")[2] in L.BEFORE_NUMBER  # a line break in "No. 1"
    if tok.isdigit() and len(tok) <= 3 and (_skip(text, sent_start) == head or not numbered and text[max(0, head - 8) : head].rstrip(" \t")[-1:] == "\n"):
        return -6.0  # a list number
    cased = c.isupper()
    if last in L.BEFORE_NUMBER and c.isdigit() or c in "№#":
        return -5.0
    if low in L.INSIDE or low == "co" and text.startswith(("KG", "Ltd", "Inc"), nxt):
        return -5.0
    if (prev.rpartition(".")[2], last) in L.INSIDE_PAIRS:
        return -5.0
    if tok.isdigit() and prev in _BEFORE_ORDINAL:
        return -4.0
    if last == "m" and prev in ("p", "a"):
        return 4.0 if cased or c in "«“„\"¿¡" else -4.0
    if last in L.TITLES and "." not in tok:
        if last == "г" and prev.isdigit():
            return 4.0
        return 2.0 if last == "s" and not c.isdigit() else -5.0
    if "ऀ" <= p <= "෿":
        return -5.0  # scripts with a danda of their own use the full stop for abbreviations only
    if "฀" <= p <= "๿":
        return -5.0  # Thai
    if "؀" <= p <= "ۿ":
        if len(last) == 1:
            unit = "." in tok or prev.isdigit()
            return 2.0 if unit and _arabic_opens(text, nxt) else -4.0
        return 5.0 if last not in L.TITLES else -5.0
    if len(last) == 1 and last.upper() != last and "." not in tok:
        if not tok.isupper():
            return 4.0 if last in "чг" and prev.isdigit() and cased else -4.0
        # J. R. Name is a person, Name S. A. a company
        second = text[max(0, dot - 4) : dot]
        if second[:1].isupper() and second[1:3] == ". " and second[3:] == tok:
            head = _rstrip(text, sent_start, dot - 4)
            w = _token(text, max(sent_start, head - 30), head)
            return 2.0 if w and w[0].isupper() and len(w) > 1 and tok == "A" and (cased or c in "¿¡«“") else -4.0
        return -5.0
    if p.isascii() and p.isalpha() and not cased and not c.isdigit() and c.isalpha():
        # Latin word before a caseless script: an abbreviation stays open, a sentence ends
        return 3.0 if low not in ("ltd", "co", "inc", "dr", "no", "p", "vol") and len(last) > 1 else -4.0
    if "가" <= c <= "힣" and p.isascii() and p.isalpha():
        return -3.0
    return 5.0 if cased else 4.0


def _arabic_opens(text: str, at: int) -> bool:
    rest = text[at : at + 40]
    if rest.startswith(L.ARABIC_OPENERS):
        return True
    word = regex.match(r"[\p{L}\p{M}]*", rest)[0]
    # a preposition written with its noun also carries the sentence on
    joined = word[:1] == "ل" and len(word) > 3 and not word.startswith(L.ARABIC_LAM_OPENERS)
    return word not in L.ARABIC_CONTINUES and not joined


def _rstrip(text: str, lo: int, hi: int) -> int:
    while hi > lo and text[hi - 1].isspace():
        hi -= 1
    return hi


def _close_of(text: str, i: int) -> int:
    """Index of the mark that closes the quotation or bracket opened at i, or -1."""
    o = text[i]
    if o == '"':
        return text.find('"', i + 1)
    ends = PAIRS.get(o) or BRACKETS[o]
    first = min((j for c in ends if (j := text.find(c, i + 1)) >= 0), default=-1)
    if first < 0 or o in "“„" or text.find(o, i + 1, first) < 0:
        return first
    depth = 0  # pairs of one kind inside each other
    for m in regex.finditer("[" + regex.escape(o + ends) + "]", text, pos=i):
        depth += 1 if m[0] == o else -1
        if not depth:
            return m.start()
    return first


def _after_pair(text: str, sent_start: int, i: int, j: int) -> bool:
    """Whether the pair text[i..j] that holds an end mark also ends the sentence."""
    k = _rstrip(text, i + 1, j)
    if k <= i + 1:
        return False
    m = text[k - 1]
    if m not in HARD and m not in DOTS:
        return False
    if m in DOTS and text[max(i, k - 2) : k] in ("..", "……") or m in "…‥":
        return False
    n = len(text)
    nxt = _skip(text, j + 1)
    if nxt >= n:
        return True
    c = text[nxt]
    if c.islower() or c in ",;:،、，؛—–-.!?。！？)）":
        return False
    bracket = text[i] in BRACKETS
    head = _rstrip(text, sent_start, i)
    if head <= sent_start or (text[sent_start:head].rstrip(".)）、．").strip().isdigit()):
        kind = "start"
    elif text[head - 1] in ":：":
        kind = "start" if _SPEAKER.fullmatch(text, sent_start, head) else "colon"
    else:
        kind = "mid"
    if c.isupper() or c in "¿¡":
        return not (bracket and kind == "mid")
    if c in PAIRS or c == '"' or c in BRACKETS or c.isdigit():
        return kind == "colon" or kind == "start"
    if bracket:
        return kind == "start"
    return kind == "colon"


#: A path of the lattice: score, start of the open sentence, last list number, and the cuts so far, linked.
Partial = tuple[float, int, int, "tuple | None"]


def _ends_of(text: str, m: regex.Match, start: int) -> tuple[int, float]:
    """(end, log odds) of a sentence that ends with the end marks of `m`, closing marks included."""
    n, end, run = len(text), m.end(), m[0]
    if run == ".":
        gain = dot_gain(text, m.start(), start)
    elif run in HARD if len(run) == 1 else any(c in HARD for c in run):
        gain = 6.0
    else:
        gain = 6.0 if _skip(text, end) >= n else -6.0
    if gain > -SURE:
        while end < n:  # closing marks without an opening one
            j = end
            while j < n and text[j] in "   ":
                j += 1
            if j < n and text[j] in "”»」』›》)）]】}］" and (j == end or text[j] == "»"):
                end = j + 1
            else:
                break
    return end, gain


def _thai_blank(text: str, a: int, b: int, words: Words) -> float:
    """Log odds that the blank text[a:b] of a Thai text ends a sentence."""
    n = len(text)
    if _GAP_NEIGHBOUR.match(text[a - 1] if a else " ") or _GAP_NEIGHBOUR.match(text[b] if b < n else " "):
        return -SURE - 2
    if text.startswith(L.THAI_COMPANY_AFTER, b) or text[max(0, a - 12) : a].endswith(L.THAI_COMPANY_BEFORE):
        return -SURE - 2
    score = GAP["thai"]
    for table, run, at_end in ((words.ends, text[max(0, a - 8) : a], True), (words.opens, text[b : b + 12], False)):
        score += max(0.0, Words._known(table, run, "", at_end))
    return score


def _gap_gain(text: str, a: int, b: int, words: Words) -> float:
    """Log odds of a sentence end in the gap text[a:b] between spaceless letters; the runs beside it are
    looked at as far as 40 letters, which hold more than the words that count."""
    left = _RUN_BEFORE.match(text, pos=max(0, a - 40), endpos=a)
    right = _SPACELESS.match(text, b, b + 40)
    if left is None or right is None:
        return -SURE - 2
    kind = "none" if a == b else "break" if "\n" in text[a:b] else "blank"
    return words.gain(left[0], right[0], kind)


def _pair_gain(text: str, i: int, j: int) -> float:
    """Log odds that the marks at i and j are one quotation or bracket rather than two lone marks."""
    if text[i] != '"':
        return 4.0
    outside = i == 0 or not text[i - 1].isalnum()
    inside = text[i + 1 : i + 2].strip() != "" and not text[j - 1].isspace()
    return 3.0 * (outside + inside) - 2.0


#: A place where a sentence could end: start, kind, and its match or span.
Event = tuple[int, str, object]


def _events(text: str, thai: bool) -> list[Event]:
    events: list[Event] = [(m.start(), m.lastgroup if m.lastgroup != "k" else "l", m) for m in (_THAI_EVENT if thai else _EVENT).finditer(text)]
    if not thai and not text.isascii() and _WIDE.search(text):
        if _BLANK.search(text):
            for m in _SPACELESS_GAP.finditer(text):
                events.append((m.start(), "g", (m.start(), m.end())))
        for m in _UNMARKED.finditer(text):
            events.append((m.start(1), "g", (m.start(1), m.start(1))))
        events.sort(key=lambda e: (e[0], e[1] != "g"))
    return events


def _best_cuts(text: str, thai: bool, words: Words) -> list[int]:
    """Ends of the sentences on the best path through the lattice of a text, the last one left out.

    As long as every edge is sure there is one path, which is followed here; `_lattice` takes over from the first
    place with two edges.
    """
    n, events = len(text), _events(text, thai)
    size = len(events)
    if not size or size == 1 and events[0][1] == "t" and _skip(text, events[0][2].end()) >= n:
        return []
    start, score, last, cuts = _skip(text, 0), 0.0, 1 if _LIST_START.match(text) else 0, None
    lone: set[str] = set()  # openers without a closing mark in the rest of the text
    k = 0
    while k < size:
        i, kind, m = events[k]
        to, number, pair = k + 1, last, 0.0
        if i < start:
            k = to
            continue
        if kind == "t":
            end, gain = _ends_of(text, m, start)
        elif kind == "n":
            end, gain = i, 6.0
        elif kind == "l":
            if not last or int(m["k"]) != last + 1:
                k = to
                continue
            end, gain, number = i, 6.0, last + 1
        elif kind in ("w", "g"):
            end, b = m.span() if kind == "w" else m
            gain = _thai_blank(text, end, b, words) if kind == "w" else _gap_gain(text, end, b, words)
        else:
            j = -1 if m[0] in lone else _close_of(text, i)
            if j < 0:
                lone.add(m[0])
                k = to
                continue
            pair = _pair_gain(text, i, j)
            if pair < SURE:
                break
            while to < size and events[to][0] <= j:
                to += 1
            end, gain = j + 1, 5.0 if _after_pair(text, start, i, j) else -5.0
        if -SURE < gain < SURE and end > start:
            break
        score += pair
        if end > start and gain > -SURE:
            start, score, last, cuts = _skip(text, end), score + gain, number, (end, cuts)
            k += 1
            while k < size and (k < to or events[k][0] < start):
                if events[k][1] == "l" and last and int(events[k][2]["k"]) == last + 1:
                    last += 1  # the cut itself ends at the next item of the list
                k += 1
        else:
            k = to
    if k < size:
        cuts = _lattice(text, words, events, k, (score, start, last, cuts), lone)
    out: list[int] = []
    while cuts:
        out.append(cuts[0])
        cuts = cuts[1]
    return out[::-1]


def _lattice(text: str, words: Words, events: list[Event], begin: int, path: Partial, lone: set[str]) -> tuple | None:
    """The linked cuts of the best path that goes on from `path` at the event `begin`."""
    at = [e[0] for e in events]
    gains: dict[int, float] = {}  # of gaps and blanks, which don't depend on the path
    places: dict[int, dict[int, Partial]] = {begin: {path[1]: path}}

    def put(k: int, p: Partial) -> None:
        here = places.setdefault(k, {})
        old = here.get(p[1])
        if old is None or p[0] > old[0]:
            here[p[1]] = p

    def fork(k: int, p: Partial, end: int, gain: float, to: int, number: int = -1) -> None:
        """Both edges at a place where a sentence may end, or only the likely one where it is sure."""
        if end > p[1] and gain > -SURE:
            start = _skip(text, end)
            nxt, last = max(to, bisect_left(at, start)), p[2] if number < 0 else number
            for _, kind, m in events[k + 1 : nxt]:
                if kind == "l" and last and int(m["k"]) == last + 1:
                    last += 1  # the cut itself ends at the next item of the list
            put(nxt, (p[0] + gain, start, last, (end, p[3])))
            if gain >= SURE:
                return
        put(to, p)

    for k in range(begin, len(events)):
        i, kind, m = events[k]
        here = places.pop(k, None)
        if here is None:
            continue
        for p in here.values() if len(here) == 1 else sorted(here.values(), key=lambda x: -x[0])[:BEAM]:
            if i < p[1]:
                put(k + 1, p)
            elif kind == "t":
                end, gain = _ends_of(text, m, p[1])
                fork(k, p, end, gain, k + 1)
            elif kind == "n":
                fork(k, p, i, 6.0, k + 1)
            elif kind == "l":
                if p[2] and int(m["k"]) == p[2] + 1:
                    fork(k, p, i, 6.0, k + 1, p[2] + 1)
                else:
                    put(k + 1, p)
            elif kind in ("w", "g"):
                a, b = m.span() if kind == "w" else m
                if k not in gains:
                    gains[k] = _thai_blank(text, a, b, words) if kind == "w" else _gap_gain(text, a, b, words)
                fork(k, p, a, gains[k], k + 1)
            else:
                j = -1 if m[0] in lone else _close_of(text, i)
                if j < 0:
                    lone.add(m[0])
                    put(k + 1, p)
                    continue
                to = bisect_left(at, j + 1)
                inner = [e[2] for e in events[k + 1 : to] if e[1] == "t"]
                pair = _pair_gain(text, i, j)
                # an end mark inside is explained by the quotation, or else has to end a sentence
                held = sum(max(0.0, _ends_of(text, t, i + 1)[1]) for t in inner[:64]) if pair < SURE and inner else 0.0
                q = (p[0] + pair + held, *p[1:])
                fork(k, q, j + 1, 5.0 if _after_pair(text, p[1], i, j) else -5.0, to)
                if pair < SURE and inner:
                    put(k + 1, p)
    last = max(places.get(len(events), {}).values(), key=lambda x: x[0], default=None)
    return last[3] if last else None


def spans(text: str | None, words: Words | None = None) -> list[tuple[int, int]]:
    """Spans of the sentences of `text`; white space around them is left out.

    `words` is the dictionary of the scripts without spaces (without it the fixed words).
    """
    if not text or text.isspace():
        return []
    n = len(text)
    out: list[tuple[int, int]] = []
    s = _skip(text, 0)
    for e in [*_best_cuts(text, _is_thai(text), words or _FIXED_WORDS), n]:
        e2 = _rstrip(text, s, e)
        if e2 > s:
            if out and not text[s].isalnum() and _BARE.search(text, s, e2) is None:
                out[-1] = (out[-1][0], e2)
            else:
                out.append((s, e2))
        s = _skip(text, e) if e < n else n
    return out


def split_sentences(df: DataFrame, text: str, keys: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """One row (keys, sent_no, char_start, char_end) for each sentence of column `text`.

    The job is a scan without a shuffle. Rows that repeat a key give repeated sentences; call
    `.distinct()` on the result, which moves offsets instead of texts.
    """
    base = df.select(*keys, F.col(text).alias("_text")).where("length(trim(_text)) > 0")
    # some hundred words, from the driver: executors may not have the vocabulary
    given = share(df.sparkSession, load_words(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared(given)
        for pdf in batches:
            rows, no, a, b = [], [], [], []
            for r, t in enumerate(pdf["_text"]):
                for k, (s, e) in enumerate(spans(t, words)):
                    rows.append(r)
                    no.append(k)
                    a.append(s)
                    b.append(e)
            out = pdf[keys].iloc[rows].reset_index(drop=True)
            yield out.assign(sent_no=pd.array(no, "int32"), char_start=pd.array(a, "int32"), char_end=pd.array(b, "int32"))

    schema = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "_text")
    return base.mapInPandas(run, schema + ", sent_no int, char_start int, char_end int")
