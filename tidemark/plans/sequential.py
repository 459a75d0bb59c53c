"""SQL twins of the sequential rules: recursive queries that take one row of every episode a step.

They are the specification that the streamed kernels are compared with, written without them.
"""

from __future__ import annotations

from tidemark.plans import base as B

PHRASE_GROUP = f"""WITH RECURSIVE {B.WRD},
o AS (SELECT ep, ws AS s, we AS e, word, row_number() OVER (PARTITION BY ep ORDER BY idx, word_no) AS n FROM wrd WHERE word IS NOT NULL AND ws >= 0 AND we >= ws),
p AS (SELECT *, n = 1 OR s - lag(e) OVER w > 300 OR regexp_matches(lag(word) OVER w, '[，。！？；、…,.!?;]$') AS hard FROM o WINDOW w AS (PARTITION BY ep ORDER BY n)),
r AS (SELECT ep, n, 0 AS no, s AS first FROM p WHERE n = 1
  UNION ALL SELECT p.ep, p.n, r.no + CASE WHEN p.hard OR p.s - r.first > 15000 THEN 1 ELSE 0 END, CASE WHEN p.hard OR p.s - r.first > 15000 THEN p.s ELSE r.first END
  FROM r JOIN p ON p.ep = r.ep AND p.n = r.n + 1)
SELECT ep, no AS phrase_no, min(first) AS s, arg_max(e, n) AS e, string_agg(word, '' ORDER BY n) AS text, CAST(count(*) AS INT) AS n_words FROM r JOIN p USING (ep, n) GROUP BY ep, no"""

SUBTITLE_UNITS = f"""WITH RECURSIVE {B.UNI},
o AS (SELECT ep, idx, s, e, speaker, coalesce(target_text, '') AS text, row_number() OVER (PARTITION BY ep ORDER BY idx) AS n FROM uni),
r AS (SELECT ep, n, 0 AS no, s, e, speaker, text, 1 AS n_cues, greatest(0, e // 500 - s // 500) AS n_frames FROM o WHERE n = 1
  UNION ALL SELECT o.ep, o.n, r.no + CASE WHEN goes THEN 0 ELSE 1 END, CASE WHEN goes THEN r.s ELSE o.s END, CASE WHEN goes THEN greatest(r.e, o.e) ELSE o.e END, o.speaker,
    CASE WHEN goes THEN r.text || ' ' || o.text ELSE o.text END, CASE WHEN goes THEN r.n_cues + 1 ELSE 1 END, greatest(0, o.e // 500 - o.s // 500) + CASE WHEN goes THEN r.n_frames ELSE 0 END
  FROM r JOIN o ON o.ep = r.ep AND o.n = r.n + 1,
  LATERAL (SELECT r.speaker IS NOT DISTINCT FROM o.speaker AND NOT regexp_matches(r.text, '[.!?…。！？]["''”’»)]*\\s*$') AND o.s - r.e <= 1200 AND o.e - r.s <= 15000 AS goes) g)
SELECT ep, CAST(no AS INT) AS unit_no, s, e, speaker, text, CAST(n_cues AS INT) AS n_cues, CAST(n_frames AS BIGINT) AS n_frames FROM (SELECT *, row_number() OVER (PARTITION BY ep, no ORDER BY n DESC) AS k FROM r) WHERE k = 1"""

#: Needs the CTE plab (labelled pieces). held: the piece that may grow; ahead: an orphan that waits for the next piece.
ORPHANS = """o AS (SELECT ep, idx, bucket, s, e, speaker, coalesce(text, '') AS text, n_words, row_number() OVER (PARTITION BY ep ORDER BY idx, bucket) AS n FROM plab),
now0 AS (SELECT ep, n, {{'idx': idx, 'bucket': bucket, 's': s, 'e': e, 'speaker': speaker, 'text': text, 'n_words': n_words, 'm': 1}} AS p FROM o),
r AS (SELECT ep, n, CASE WHEN length(trim(p.text)) < 2 THEN NULL ELSE p END AS held, CASE WHEN length(trim(p.text)) < 2 THEN p END AS ahead, [] :: STRUCT(idx INT, bucket INT, s BIGINT, e BIGINT, speaker VARCHAR, "text" VARCHAR, n_words BIGINT, m INT)[] AS done
    FROM now0 WHERE n = 1
  UNION ALL SELECT ep, n,
    CASE WHEN NOT orphan THEN now WHEN grows THEN {{'idx': h.idx, 'bucket': h.bucket, 's': h.s, 'e': greatest(h.e, now.e), 'speaker': h.speaker, 'text': h.text || now.text, 'n_words': h.n_words + now.n_words, 'm': h.m + now.m}} ELSE h END,
    CASE WHEN orphan AND NOT grows THEN now END,
    CASE WHEN a IS NOT NULL AND NOT joins AND held IS NOT NULL THEN [held] ELSE [] END || CASE WHEN NOT orphan AND h IS NOT NULL THEN [h] ELSE [] END
  FROM (SELECT *, length(trim(now.text)) < 2 AS orphan, h IS NOT NULL AND h.speaker IS NOT DISTINCT FROM now.speaker AS grows FROM (
    SELECT *, CASE WHEN a IS NOT NULL AND NOT joins THEN a ELSE held END AS h,
      CASE WHEN joins THEN {{'idx': p.idx, 'bucket': p.bucket, 's': least(p.s, a.s), 'e': greatest(p.e, a.e), 'speaker': p.speaker, 'text': a.text || p.text, 'n_words': a.n_words + p.n_words, 'm': p.m + a.m}} ELSE p END AS now
    FROM (SELECT x.ep, x.n, x.p, r.held, r.ahead AS a, r.ahead IS NOT NULL AND r.ahead.speaker IS NOT DISTINCT FROM x.p.speaker AS joins FROM r JOIN now0 x ON x.ep = r.ep AND x.n = r.n + 1)))),
pieces_out AS (SELECT ep, unnest(done) AS p FROM r UNION ALL
  SELECT ep, unnest(CASE WHEN held IS NULL THEN [] ELSE [held] END || CASE WHEN ahead IS NULL THEN [] ELSE [ahead] END) FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY n DESC) AS k FROM r) WHERE k = 1)""".replace("{{", "{").replace("}}", "}")

_TURNS_T = f"""t0 AS (SELECT ep, idx, s AS cue, CAST({B.n_words('target_text')} * 400 + 200 AS BIGINT) AS dur, e FROM uni),
t AS (SELECT ep, idx, cue, dur, dur // 10 AS pause, coalesce(lead(cue) OVER w, max(total) OVER (PARTITION BY ep)) AS nxt, lead(cue) OVER w IS NULL AS last, row_number() OVER w AS n
  FROM (SELECT *, arg_max(e, idx) OVER (PARTITION BY ep) + 500 AS total FROM t0) WINDOW w AS (PARTITION BY ep ORDER BY idx))"""
#: Fitted duration of a turn with one pause: what is left of the pause after cutting or stretching it, then the tempo.
_FITTED = """SELECT *, CASE WHEN win <= 0 THEN dur ELSE CAST(round_even((dur - pause + quiet) / CASE WHEN least(dur, dur - pause + quiet) > 1.005 * win THEN least((dur - pause + quiet) / win, 1.12) ELSE 1.0 END, 0) AS BIGINT) END AS fitted FROM (
  SELECT *, CASE WHEN dur > 1.005 * win THEN least(pause, 120.0) WHEN dur < 0.98 * win AND pause >= 100 THEN least(pause * least(1 + (least(win, dur + 2000) - dur) / CAST(pause AS DOUBLE), 2.0), 1500.0) ELSE CAST(pause AS DOUBLE) END AS quiet FROM ({0}))"""
_WAY = "CASE WHEN fitted > win * 1.005 THEN 'tighter' WHEN win >= 2500 AND win - fitted > 1500 AND (last OR fitted < 0.85 * win) THEN 'fuller' END"


def _timeline(start: str, window: str, late: str, end: str) -> str:
    step = f"SELECT *, {window} AS win FROM (SELECT *, {start} AS start FROM (SELECT t.*, {{0}} AS earliest FROM {{1}}))"
    head = _FITTED.format(step.format("t.cue", "t WHERE n = 1"))
    tail = _FITTED.format(step.format("greatest(r.ended + 250, t.cue - 1500)", "r JOIN t ON t.ep = r.ep AND t.n = r.n + 1"))
    cols = f"ep, idx, n, cue, start, win, fitted, {_WAY} AS way, {late} AS misplaced"
    return f"""WITH RECURSIVE {B.UNI}, {_TURNS_T},
r AS (SELECT {cols}, CAST({end} AS BIGINT) AS ended FROM ({head}) UNION ALL SELECT {cols}, CAST({end} AS BIGINT) FROM ({tail}))
SELECT ep, CAST(idx AS BIGINT) AS idx, CAST(start AS BIGINT) AS start, CAST(win AS BIGINT) AS "window", fitted, CAST(start - cue AS BIGINT) AS lag, way AS direction, misplaced FROM r"""


TIMELINE_FIT = _timeline("earliest", "nxt - 250 - start", "start > cue + 1000 OR win <= 0", f"start + CASE WHEN {_WAY} IS NOT NULL THEN least(fitted, greatest(win, 0)) ELSE fitted END")
SIMULATE = _timeline("least(earliest, cue + 1000)", "greatest(nxt - 250 - start, 50)", "earliest > cue + 1000 OR win <= 0", "start + least(dur, win)")

_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Parts (ep, idx, part, text) of long units, packed from sentences.
_PACKED = f"""u AS (SELECT ep, idx, target_text AS t FROM uni WHERE {B.n_words('target_text')} > 275),
s0 AS (SELECT ep, idx, unnest(str_split(regexp_replace(t, '([.!?…]){_BLANK}+', '\\1' || chr(1), 'g'), chr(1))) AS st, generate_subscripts(str_split(regexp_replace(t, '([.!?…]){_BLANK}+', '\\1' || chr(1), 'g'), chr(1)), 1) AS k FROM u),
s AS (SELECT *, {B.n_words('st')} AS w, row_number() OVER (PARTITION BY ep, idx ORDER BY k) AS n FROM s0 WHERE st <> ''),
r AS (SELECT ep, idx, n, 0 AS part, CASE WHEN w > 275 THEN 0 ELSE w END AS size, w <= 275 AS open, CASE WHEN w > 275 THEN (w + 274) // 275 ELSE 0 END AS nxt FROM s WHERE n = 1
  UNION ALL SELECT s.ep, s.idx, s.n,
    CASE WHEN r.open THEN r.part + CASE WHEN s.w > 275 OR r.size + s.w > 275 THEN 1 ELSE 0 END ELSE r.nxt END,
    CASE WHEN s.w > 275 THEN 0 WHEN r.open AND r.size + s.w <= 275 THEN r.size + s.w ELSE s.w END, s.w <= 275,
    CASE WHEN s.w > 275 THEN CASE WHEN r.open THEN r.part + 1 ELSE r.nxt END + (s.w + 274) // 275 ELSE 0 END
  FROM r JOIN s ON s.ep = r.ep AND s.idx = r.idx AND s.n = r.n + 1),
j AS (SELECT r.ep, r.idx, r.n, r.part, s.st, s.w FROM r JOIN s USING (ep, idx, n)),
got AS (SELECT ep, idx, part, string_agg(st, ' ' ORDER BY n) AS text FROM j WHERE w <= 275 GROUP BY ep, idx, part UNION ALL
  SELECT ep, idx, part + i, array_to_string(regexp_extract_all(st, '{B.NONBLANK}')[i * 275 + 1 : i * 275 + 275], ' ') FROM (SELECT *, unnest(range(0, CAST((w + 274) // 275 AS BIGINT))) AS i FROM j WHERE w > 275))"""
SENTENCE_PACK = f"""WITH RECURSIVE {B.UNI}, {_PACKED}
SELECT ep, idx, CAST(part AS INT) AS part, text, CAST({B.n_words('text')} AS INT) AS n_words FROM got"""

#: Units and the parts of long ones (fr), turns of them (tu), how many chunks each turn needs (need), and which chunk each
#: fragment goes to (bal), fragment by fragment. The borders of the shared source are a running maximum.
_CHUNKS = f"""pt AS (SELECT g.ep, g.idx, g.part, g.text, {B.n_words('g.text')} AS w, u.s, CASE WHEN u.e > u.s THEN u.e ELSE u.s + 300 END AS e, u.speaker, coalesce(u.source_text, '') AS src FROM got g JOIN uni u USING (ep, idx)),
ct AS (SELECT *, sum(w) OVER o AS cum, sum(w) OVER (PARTITION BY ep, idx) AS whole, count(*) OVER (PARTITION BY ep, idx) AS k, row_number() OVER o AS i,
  CASE WHEN len(regexp_extract_all(src, '{B.NONBLANK}')) >= count(*) OVER (PARTITION BY ep, idx) THEN regexp_extract_all(src, '{B.NONBLANK}') ELSE string_split(src, '') END AS tokens,
  CASE WHEN len(regexp_extract_all(src, '{B.NONBLANK}')) >= count(*) OVER (PARTITION BY ep, idx) THEN ' ' ELSE '' END AS sep FROM pt WINDOW o AS (PARTITION BY ep, idx ORDER BY part)),
bd AS (SELECT *, CASE WHEN i = k THEN len(tokens) ELSE least(len(tokens) - k + 1, greatest(1, max(CASE WHEN i < k THEN round_even(len(tokens) * cum / whole, 0) - (i - 1) END) OVER (PARTITION BY ep, idx ORDER BY i))) + i - 1 END AS cut FROM ct),
fr AS (SELECT ep, idx, CAST(0 AS BIGINT) AS part, s, e, speaker, coalesce(target_text, '') AS target, coalesce(source_text, '') AS source, {B.n_words('target_text')} AS w FROM uni WHERE {B.n_words('target_text')} <= 275
  UNION ALL SELECT ep, idx, part, s + CAST((e - s) * (cum - w) // whole AS BIGINT), s + CAST((e - s) * cum // whole AS BIGINT), speaker, text,
    regexp_replace(CASE WHEN sep = ' ' THEN array_to_string(mine, ' ') ELSE array_to_string(mine, '') END, '^{_BLANK}+|{_BLANK}+$', '', 'g'), w
    FROM (SELECT *, tokens[coalesce(lag(CAST(cut AS BIGINT)) OVER (PARTITION BY ep, idx ORDER BY i), 0) + 1 : CAST(cut AS BIGINT)] AS mine FROM bd)),
tu AS (SELECT *, row_number() OVER (PARTITION BY ep, turn ORDER BY idx, part) - 1 AS j, count(*) OVER (PARTITION BY ep, turn) AS n, sum(w) OVER (PARTITION BY ep, turn) AS words, first_value(s) OVER (PARTITION BY ep, turn ORDER BY idx, part) AS begin,
  max(CASE WHEN e > s THEN e ELSE s + 300 END) OVER (PARTITION BY ep, turn) AS until FROM (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY ep ORDER BY idx, part) - 1 AS turn FROM (
    SELECT *, coalesce(lag(idx) OVER o IS NOT NULL AND speaker IS NOT DISTINCT FROM lag(speaker) OVER o AND s - lag(e) OVER o <= 2500, false) AS goes FROM fr WINDOW o AS (PARTITION BY ep ORDER BY idx, part)))),
gr AS (SELECT ep, turn, j, 1 AS bins, w AS room FROM tu WHERE j = 0
  UNION ALL SELECT t.ep, t.turn, t.j, g.bins + CASE WHEN g.room + t.w > 275 THEN 1 ELSE 0 END, CASE WHEN g.room + t.w > 275 THEN t.w ELSE g.room + t.w END FROM gr g JOIN tu t ON t.ep = g.ep AND t.turn = g.turn AND t.j = g.j + 1),
need AS (SELECT t.ep, t.turn, CAST(least(any_value(n), greatest(max(bins), ceil((any_value(until) - any_value(begin)) / 110000.0))) AS BIGINT) AS k FROM tu t JOIN gr USING (ep, turn, j) GROUP BY t.ep, t.turn),
bal AS (SELECT t.ep, t.turn, j, CAST(0 AS BIGINT) AS no, q.k AS rest, CAST(w AS HUGEINT) AS got, CAST(words AS HUGEINT) AS remains FROM tu t JOIN need q ON q.ep = t.ep AND q.turn = t.turn WHERE j = 0
  UNION ALL SELECT ep, turn, j, no + CASE WHEN opens THEN 1 ELSE 0 END, rest - CASE WHEN opens THEN 1 ELSE 0 END, CASE WHEN opens THEN w ELSE got + w END, remains - CASE WHEN opens THEN got ELSE 0 END FROM (
    SELECT t.ep, t.turn, t.j, b.no, b.rest, b.got, b.remains, t.w, b.rest > 1 AND (t.j >= t.n - (b.rest - 1) OR b.got + t.w > 275
      OR b.got >= greatest(0, b.remains - 275 * (b.rest - 1)) AND abs(b.got - b.remains / b.rest) <= abs(b.got + t.w - b.remains / b.rest)) AS opens
    FROM bal b JOIN tu t ON t.ep = b.ep AND t.turn = b.turn AND t.j = b.j + 1)),
ch AS (SELECT ep, turn, no, sum(w) AS n, array_to_string(list(target ORDER BY j), ' ') AS text, regexp_replace(array_to_string(list(source ORDER BY j), ' '), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS source_text, any_value(begin) AS begin, any_value(until) AS until, any_value(words) AS words, min(speaker) AS speaker FROM tu JOIN bal USING (ep, turn, j) GROUP BY ep, turn, no),
chunks AS (SELECT ep, CAST(turn AS INT) AS turn_id, CAST(no AS INT) AS part_index, begin + CAST((until - begin) * (cum - n) // greatest(1, words) AS BIGINT) AS s,
  CASE WHEN no = last THEN until ELSE begin + CAST((until - begin) * cum // greatest(1, words) AS BIGINT) END AS e, speaker, text, source_text, CAST(n AS INT) AS n_words
  FROM (SELECT *, sum(n) OVER (PARTITION BY ep, turn ORDER BY no) AS cum, max(no) OVER (PARTITION BY ep, turn) AS last FROM ch))"""
TURN_CHUNKS = f"WITH RECURSIVE {B.UNI}, {_PACKED}, {_CHUNKS} SELECT * FROM chunks"
TURN_REPORT = f"""WITH RECURSIVE {B.UNI}, {_PACKED}, {_CHUNKS}
SELECT ep, turn_id, any_value(speaker) AS speaker, min(s) AS s, arg_max(e, part_index) AS e, array_to_string(list(text ORDER BY part_index), ' ') AS text, count(*) AS n_parts FROM chunks GROUP BY ep, turn_id"""
