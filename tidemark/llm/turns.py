"""Speech transcripts into clean, ordered speaker turns.

Every row's text is scanned into tokens: clock times, bracketed notes, name prefixes, hesitation sounds and
stretches of text. A token's kind says only what it looks like (`KINDS`); which of the labels speaker,
timestamp, annotation, filler and speech it gets is decided by a hidden Markov model over the whole row
(`TurnModel`), whose states also know whether speech has begun: the same clock time is a time mark in front
of the speech and spoken after it, and a name counts only in front. Viterbi picks the best labelling, and the
speech tokens are the clean text.

Emission and transition scores are estimated from counts: those of `PRIOR_*` and those of a bounded sample of
rows that label themselves (`self_labelled`): a clock time that agrees with the row's start is a time mark, a
name that agrees with the row's speaker names it.

Rows then become turns: a row without a named speaker takes that of the last spoken row before. An
episode is worked in stretches of time, and only the first and last runs of a stretch meet in a window of
the whole episode, so a single long episode is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import lexicon as L
from tidemark.session import share, shared

#: Seconds of an episode that are worked together.
STRETCH_S = 600

_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_OPEN, _CLOSE = r"[\[(<{【（［〈]", r"[\])>}】）］〉]"
_SOUND = regex.compile(r"(?:(?:%s)(?:\s*\d+(?:[.,]\d+)?\s*(?:s|sec|秒|с)?)?[\s,;+&/]*)+" % "|".join(L.SOUNDS), regex.I)
_LEAD_NAME = regex.compile(r"\s*(?:>>+|[-–—])?\s*(?P<n>[^\s:：\[\](){}<>—–][^:：\[\](){}<>—–]{0,38}?)(?:\s*[:：]|\s+[—–]|\s+-(?=\s))\s*")
_LEAD_MARK = regex.compile(r"\s*(?:>>+|[-–—](?=\s))\s*")
_NAME_END = regex.compile(r"[:：—–]|\s-\s")
_TIME = regex.compile(r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d{1,3}))?")
_BARE = regex.compile(r"[\p{L}\p{N}]")
_LABEL_NOTE = regex.compile(r"\s*[(\[（][^)\]）]*[)\]）]\s*$")
_LABEL_GAP = regex.compile(r"[\s_\-.]+")
_NUMBERED = regex.compile(r"\D*?(\d+)")
_REMARK = regex.compile(r"[.!?。！？؟।…\d]")

SPK, TIME, NOTE, FILL, SPEECH = range(5)
#: Labels of the states: four before the speech, the speech, and three after it began.
STATES = (SPK, TIME, NOTE, FILL, SPEECH, TIME, NOTE, FILL)
START = len(STATES)
#: What tokens look like: a clock time in brackets or as a range; one written bare, as at a line's head; a bracket
#: with the name of a sound; a bracket with other words, square or round; one with end marks or digits; a name or
#: role of the roster with a colon or dash; a mark of a new speaker; a hesitation sound; other text.
KINDS = ("clock", "bare", "sound", "note", "aside", "remark", "name", "mark", "fill", "text")
# --- fixed values: prior counts of the kinds by state
PRIOR_KINDS = (
    # clock bare sound note aside remark name mark fill text
    (0.01, 0.01, 0.01, 0.3, 0.1, 0.01, 30.0, 8.0, 0.01, 0.3),  # speaker
    (30.0, 10.0, 0.01, 0.1, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01),  # time mark
    (0.01, 0.01, 30.0, 8.0, 4.0, 0.05, 0.01, 0.01, 0.01, 0.01),  # annotation
    (0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 30.0, 0.01),  # filler
    (0.01, 3.0, 0.01, 0.3, 1.0, 20.0, 0.2, 0.2, 0.2, 300.0),  # speech
    (30.0, 0.05, 0.01, 0.1, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01),  # time mark in the speech
    (0.01, 0.01, 30.0, 8.0, 4.0, 0.05, 0.01, 0.01, 0.01, 0.01),  # annotation in the speech
    (0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 30.0, 0.01),  # filler in the speech
)
_BEFORE, _AFTER = (6.0, 6.0, 3.0, 3.0, 20.0, 0.0, 0.0, 0.0), (0.001, 0.0, 0.0, 0.0, 20.0, 4.0, 4.0, 4.0)
# --- fixed values: prior counts of the states by the state before; the last row is the start of a text
PRIOR_NEXT = (_BEFORE, _BEFORE, _BEFORE, _BEFORE, _AFTER, _AFTER, _AFTER, _AFTER, _BEFORE)
_NO = -1e9


@dataclass(frozen=True)
class TurnFit:
    """Bounds of the self-labelled sample: at most episodes * rows rows of the transcript."""

    episodes: int = 150
    rows: int = 40
    #: seconds by which a written time may differ from the row's start
    near_s: float = 1.5
    seed: int = 7


@dataclass
class TurnModel:
    """Log probabilities of kinds by state (`looks`) and of states by the state before (`follows`)."""

    looks: dict[str, list[float]]
    follows: list[list[float]]
    known: dict[tuple[str, ...], tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def fit(cls, rows: Iterable[list[tuple[str, int]]] = ()) -> TurnModel:
        """The model of the prior counts and of rows of (kind, label)."""
        kinds, nexts = np.array(PRIOR_KINDS), np.array(PRIOR_NEXT)
        for row in rows:
            before, spoken = START, False
            for kind, label in row:
                spoken = spoken or label == SPEECH
                state = label + 4 if spoken and TIME <= label <= FILL else label
                kinds[state, KINDS.index(kind)] += 1
                nexts[before, state] += 1
                before = state
        with np.errstate(divide="ignore"):
            look = np.log(kinds / kinds.sum(1, keepdims=True))
            follow = np.maximum(np.log(nexts / nexts.sum(1, keepdims=True)), _NO)
        return cls({k: look[:, i].tolist() for i, k in enumerate(KINDS)}, follow.tolist())

    def labels(self, kinds: tuple[str, ...]) -> tuple[int, ...]:
        """The best labels of a row of token kinds; rows of the same kinds are decoded once."""
        got = self.known.get(kinds)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[kinds] = self._viterbi(kinds)
        return got

    def _viterbi(self, kinds: tuple[str, ...]) -> tuple[int, ...]:
        if not kinds:
            return ()
        follows = np.array(self.follows)
        looks = np.array([self.looks[k] for k in kinds])
        score, back = follows[START] + looks[0], []
        for look in looks[1:]:
            paths = score[:, None] + follows[:START]
            back.append(paths.argmax(0))
            score = paths.max(0) + look
        state = int(score.argmax())
        out = [state]
        for frm in reversed(back):
            state = int(frm[state])
            out.append(state)
        return tuple(STATES[x] for x in reversed(out))


def _drawn(word: str) -> str:
    return regex.escape(word[:-1]) + "(?:" + regex.escape(word[-1]) + ")+"


def _scanner(lang: str) -> regex.Pattern:
    words = sorted(L.FILLERS.get(lang, ()), key=len, reverse=True)
    fill = "|".join(_drawn(w) + (r"(?:-" + regex.escape(w[-1]) + "+)*" if "-" in w else "") for w in words) or r"(?!)"
    if lang == "ko":
        fill += r"|(?:음|어|흠)+|으음+"
    return regex.compile(
        rf"(?P<clock>{_OPEN}?\s*{_CLOCK}\s*-+>\s*{_CLOCK}\s*{_CLOSE}?|{_OPEN}\s*{_CLOCK}\s*(?:[-–—]\s*{_CLOCK}\s*)?{_CLOSE}|@\s*{_CLOCK})"
        rf"|(?P<bare>(?<![\d\p{{L}}:.])(?:{_CLOCK}\s*[-–—|](?=\s|$)|\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?(?=\s|$)))"
        rf"|(?P<br>{_OPEN}(?P<in>[^\[\](){{}}<>【】（）［］〈〉]{{1,60}}){_CLOSE}|(?P<nt>[♪♫🎵*])\s*(?P<in2>[^♪♫🎵*\n]{{1,40}}?)\s*(?P=nt)|[♪♫🎵]+)"
        rf"|(?P<fill>(?<![\p{{L}}\p{{M}}\p{{N}}'’]|[\p{{L}}]-)(?:{fill})(?!-?[\p{{L}}\p{{M}}\p{{N}}'’])\s*(?:[.…,，、;—–،]+)?)",
        regex.I,
    )


def _seconds(mark: str) -> float | None:
    m = _TIME.search(mark)
    if not m:
        return None
    a, b, c = int(m[1]), int(m[2]), m[3]
    s = a * 3600 + b * 60 + int(c) if c is not None else a * 60 + b
    return s + (float("0." + m[4]) if m[4] else 0.0)


class Roster:
    """The speakers of an episode by every spelling that names exactly one of them."""

    def __init__(self, rows: list[tuple[str, str | None, str | None]]):
        keys: dict[str, set[str]] = {}

        def add(k: str | None, s: str) -> None:
            if k and k.strip():
                keys.setdefault(self.plain(k), set()).add(s)

        for speaker, display, diar in rows:
            if not speaker:
                continue
            add(speaker, speaker)
            add(diar, speaker)
            m = _NUMBERED.fullmatch(diar or "")
            if m:
                for form in ("speaker {}", "spk {}", "s {}", "speaker {:02d}", "speaker{}"):
                    add(form.format(int(m[1])), speaker)
            if display:
                parts = display.split()
                add(display, speaker)
                add(parts[0], speaker)
                if len(parts) > 1:
                    add(f"{parts[0]} {parts[-1][0]}", speaker)
                    add(f"{parts[0][0]} {parts[-1]}", speaker)
                    add(f"{parts[-1]} {parts[0]}", speaker)
                    add(parts[-1], speaker)
        self.keys = {k: next(iter(v)) for k, v in keys.items() if len(v) == 1}
        self.long = [k for k in self.keys if len(k) >= 7 and " " in k]
        self.seen: dict[str, str | None] = {}

    @staticmethod
    @lru_cache(maxsize=20_000)
    def plain(label: str) -> str:
        s = _LABEL_NOTE.sub("", label.strip().casefold())
        s = s.lstrip(">-–—•*#@[ ").rstrip(":：.]-—– ")
        return _LABEL_GAP.sub(" ", s).strip()

    def find(self, label: str | None) -> str | None:
        if not label:
            return None
        if label in self.seen:
            return self.seen[label]
        k = self.plain(label)
        got = None if k in L.NOBODY else self.keys.get(k)
        if got is None and len(k) >= 7 and k not in L.NOBODY:
            near = {self.keys[x] for x in self.long if _near(k, x)}
            got = next(iter(near)) if len(near) == 1 else None
        self.seen[label] = got
        return got


def _near(a: str, b: str) -> bool:
    """At most one replaced, lost, added or two swapped letters."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


_SCANNERS: dict[str, regex.Pattern] = {}


def tokens(text: str, lang: str, roster: Roster) -> list[tuple[str | None, str, str | None]]:
    """(kind, piece, speaker named) of the tokens of a text; a kind of None has no letters and no label."""
    scan = _SCANNERS.get(lang)
    if scan is None:
        scan = _SCANNERS[lang] = _scanner(lang)
    out: list[tuple[str | None, str, str | None]] = []
    front = True

    def text_part(s: str) -> None:
        """A stretch without special tokens; in front of the speech it may begin with names and marks."""
        nonlocal front
        while front and s:
            if _NAME_END.search(s, 0, 64):
                m = _LEAD_NAME.match(s)
                who = roster.find(m["n"]) if m else None
                if who:
                    out.append(("name", m[0], who))
                    s = s[m.end() :]
                    continue
            m = _LEAD_MARK.match(s)
            if m and m.end():
                out.append(("mark", m[0], None))
                s = s[m.end() :]
                continue
            break
        if s:
            if _BARE.search(s):
                front = False
                out.append(("text", s, None))
            else:
                out.append((None, s, None))

    pos = 0
    for m in scan.finditer(text):
        if m.start() > pos:
            # a name may be written before a clock: "Name — [00:01]"
            text_part(text[pos : m.start()])
        pos = m.end()
        kind, who = m.lastgroup, None
        if m["br"] is not None:
            inner = m["in"] if m["in"] is not None else m["in2"]
            if inner is None or _SOUND.fullmatch(inner.strip()):
                kind = "sound"
            else:
                who = roster.find(inner) if front and m["in"] is not None else None
                if who:
                    kind = "name"
                elif _REMARK.search(inner) or len(inner) > 30 or not _BARE.search(inner):
                    kind = "remark"
                else:
                    kind = "aside" if m[0][0] in "(（" else "note"
        elif kind not in ("clock", "bare", "fill"):
            kind = "clock" if m["clock"] else "bare" if m["bare"] else "fill"
        out.append((kind, m[0], who))
        front = front and kind != "remark"
    if pos < len(text):
        text_part(text[pos:])
    return out


_PRIOR = TurnModel.fit()


def clean(text: str | None, lang: str, roster: Roster, model: TurnModel = _PRIOR) -> tuple[str, str | None, float | None]:
    """(clean speech, speaker named in front, time written in the text)."""
    if not text:
        return "", None, None
    found = tokens(text, lang, roster)
    if len(found) == 1 and found[0][0] == "text":
        return " ".join(text.split()), None, None
    labels = iter(model.labels(tuple(t[0] for t in found if t[0])))
    said, who, at = [], None, None
    for kind, piece, name in found:
        label = next(labels) if kind else SPEECH
        said.append(piece if label == SPEECH else " ")
        if label == SPK:
            who = who or name
        elif label == TIME and at is None:
            at = _seconds(piece)
    return " ".join("".join(said).split()), who, at


def self_labelled(text: str, lang: str, roster: Roster, start_s: float | None, label: str | None, near_s: float) -> list[tuple[str, int]] | None:
    """(kind, label) of a row that says itself what its tokens are; None where it leaves one open.

    A clock time near the row's start is a time mark, another one is spoken where it stands bare, and a bracketed one
    leaves the row open; a name must be that of the row's column, if that names one; brackets with words of
    neither list leave the row open.
    """
    sure = {"sound": NOTE, "fill": FILL, "text": SPEECH, "remark": SPEECH, "mark": SPK}
    out = []
    named = roster.find(label)
    for kind, piece, who in tokens(text, lang, roster):
        if kind is None:
            continue
        if kind in ("clock", "bare"):
            at = _seconds(piece)
            if start_s is None or not math.isfinite(start_s) or at is None:
                return None
            near = abs(at - start_s) <= near_s
            if not near and kind == "clock":
                return None
            out.append((kind, TIME if near else SPEECH))
        elif kind == "name":
            if named and who != named:
                return None
            out.append((kind, SPK))
        elif kind in sure:
            out.append((kind, sure[kind]))
        else:
            return None
    return out


def letters(s: str) -> int:
    """Characters of the Unicode categories L and N."""
    return sum(map(str.isalnum, s))


def fit_model(rows: DataFrame, cast: DataFrame, fit: TurnFit = TurnFit()) -> TurnModel:
    """The model of a bounded sample: about fit.episodes episodes drawn by a hash, of each the first fit.rows rows."""
    n = cast.count()  # one row an episode
    chance = F.pmod(F.xxhash64("ep", F.lit(fit.seed)), F.lit(1_000_000)) / 1_000_000
    chosen = cast.where(chance < F.lit(fit.episodes / max(1, n))).select("ep", "lang", "roster")
    # about fit.episodes rows
    sample = rows.where(F.col("idx") < fit.rows).select("ep", "idx", "start_s", "text", "speaker").where("length(text) > 0")
    found = []
    rosters: dict = {}
    for r in sample.join(F.broadcast(chosen), "ep").distinct().collect():
        if r["ep"] not in rosters:
            rosters[r["ep"]] = _roster(r["roster"])
        row = self_labelled(r["text"], r["lang"] or "", rosters[r["ep"]], r["start_s"], r["speaker"], fit.near_s)
        if row:
            found.append(row)
    return TurnModel.fit(found)


def _roster(rows: object) -> Roster:
    return Roster([(r["speaker"], r["display_name"], r["diar_label"]) for r in rows] if rows is not None else [])


def clean_rows(rows: DataFrame, cast: DataFrame, model: TurnModel | None = None) -> DataFrame:
    """Spoken rows with clean text: ep, idx, at_s, speaker (null: not named), clean, n_letters, end_s.

    `rows` has ep, idx, start_s, end_s, text, speaker; `cast` has ep, lang and roster, an array of
    structs (speaker, display_name, diar_label), one row an episode. A row with nothing but time marks,
    names, hesitation and annotations is left out, as are null texts. Rows that repeat (ep, idx) count once.
    `model` labels the tokens; without one, that of the prior counts.
    """
    given = share(rows.sparkSession, model or TurnModel.fit())
    base = (
        rows.select("ep", "idx", "start_s", "end_s", "text", F.col("speaker").alias("label"))
        .where("length(text) > 0")
        .join(cast.select("ep", "lang", "roster"), "ep", "left")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        m = shared(given)
        for pdf in batches:
            out = []
            for ep, start, text, label, lang, roster in zip(pdf["ep"], pdf["start_s"], pdf["text"], pdf["label"], pdf["lang"], pdf["roster"], strict=True):
                if ep not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[ep] = _roster(roster)
                r = known[ep]
                said, who, at = clean(text, lang if isinstance(lang, str) else "", r, m)
                n = letters(said)
                if start is not None and np.isfinite(start):
                    at = float(start)
                out.append((at, who or r.find(label), said, n))
            got = pd.DataFrame(out, columns=["at_s", "speaker", "clean", "n_letters"])
            got["n_letters"] = got["n_letters"].astype("int64")
            got["at_s"] = got["at_s"].astype("float64")
            yield pd.concat([pdf[["ep", "idx", "end_s"]].reset_index(drop=True), got], axis=1)

    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = f"ep {types['ep']}, idx {types['idx']}, end_s {types['end_s']}, at_s double, speaker string, clean string, n_letters bigint"
    return base.mapInPandas(run, schema).withColumn("at_s", F.nanvl("at_s", F.lit(None))).where("n_letters > 0")


def speaker_turns(spoken: DataFrame) -> DataFrame:
    """Turns (ep, first_idx, last_idx, speaker, n_letters, start_s, end_s) of spoken rows.

    A turn is a longest sequence of consecutive rows of one speaker in order of at_s, then idx; rows
    without any time come last. Rows before the first named speaker have a null speaker.
    """
    rows = spoken.withColumn("t", F.coalesce("at_s", F.lit(1e15))).withColumn("stretch", F.floor(F.col("t") / STRETCH_S))
    w = Window.partitionBy("ep", "stretch").orderBy("t", "idx")
    # rows that repeat a key are identical, so they lie next to each other in the order that the turns need anyway
    rows = rows.withColumn("seen", F.lag("idx").over(w)).where(F.coalesce(F.col("seen") != F.col("idx"), F.lit(True)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("who", F.last("speaker", ignorenulls=True).over(upto)).withColumn("old", F.lag("who").over(w)).withColumn("n", F.row_number().over(w))
    local = local.withColumn("run", F.sum(F.when((F.col("n") == 1) | ~F.col("who").eqNullSafe(F.col("old")), 1).otherwise(0)).over(upto))
    runs = local.groupBy("ep", "stretch", "run").agg(
        F.first("who").alias("who"),
        F.min_by("idx", "n").alias("first_idx"),
        F.max_by("idx", "n").alias("last_idx"),
        F.min("t").alias("t"),
        F.min("at_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.sum("n_letters").alias("n_letters"),
    )
    # runs at the edges of a stretch may go on in the next one; a run before the first name waits for it
    s = Window.partitionBy("ep", "stretch")
    runs = runs.withColumn("last_run", F.max("run").over(s)).withColumn("open", F.max(F.when((F.col("run") == 1) & F.col("who").isNull(), 1).otherwise(0)).over(s))
    edge = (F.col("run") == 1) | (F.col("run") == F.col("last_run")) | ((F.col("run") == 2) & (F.col("open") == 1))
    placed = runs.withColumn("place", F.when(edge, F.lit(-1)).otherwise(F.col("stretch")))
    v = Window.partitionBy("ep", "place").orderBy("stretch", "run")
    linked = (
        placed.withColumn("speaker", F.last("who", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("p_stretch", F.lag("stretch").over(v))
        .withColumn("p_run", F.lag("run").over(v))
    )
    linked = linked.withColumn("p_speaker", F.lag("speaker").over(v))
    next_to = (F.col("p_stretch") != F.col("stretch")) | (F.col("p_run") == F.col("run") - 1)
    joins = F.coalesce(next_to & F.col("speaker").eqNullSafe(F.col("p_speaker")) & F.col("p_run").isNotNull(), F.lit(False))
    linked = linked.withColumn("turn", F.sum(F.when(joins, 0).otherwise(1)).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct("stretch", "run")
    return (
        linked.groupBy("ep", "place", "turn")
        .agg(
            F.min_by("first_idx", order).alias("first_idx"),
            F.max_by("last_idx", order).alias("last_idx"),
            F.first("speaker").alias("speaker"),
            F.sum("n_letters").alias("n_letters"),
            F.min("start_s").alias("start_s"),
            F.max("end_s").alias("end_s"),
        )
        .drop("place", "turn")
    )


def cast_of(refs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(ep, lang, roster) of the episodes; a roster is the bounded list of an episode's speakers."""
    rosters = refs.groupBy("ep").agg(F.sort_array(F.collect_set(F.struct("speaker", "display_name", "diar_label"))).alias("roster"))
    langs = jobs.groupBy("ep").agg(F.first(F.lower(F.trim("source_lang")), ignorenulls=True).alias("lang"))
    return rosters.join(langs, "ep", "full")
