"""The core queries in DuckDB's SQL, written apart from the Spark expressions."""

from __future__ import annotations

from quirefold.functions import text as T

EL = "el AS (SELECT DISTINCT ON (doc_id, page, idx) * EXCLUDE (image, bbox), bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, bbox FROM elements)"
EL2 = """el AS (SELECT * REPLACE (CASE WHEN kind <> 'text' THEN x0 WHEN idx % 2 = 1 THEN 261 + x0 % 7 ELSE x0 END AS x0, CASE WHEN kind <> 'text' THEN x1 WHEN idx % 2 = 1 THEN 461 + x0 % 7 ELSE least(x1, 240) END AS x1) FROM
(SELECT DISTINCT ON (doc_id, page, idx) * EXCLUDE (image, bbox), bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, bbox FROM elements))"""
GEO = "geo AS (SELECT doc_id, page, max(width) AS width, max(height) AS height FROM pages_geo GROUP BY 1, 2)"
TR = "tr AS (SELECT DISTINCT ON (doc_id, page, idx) * FROM translations ORDER BY doc_id, page, idx, ingested_at DESC NULLS LAST, coalesce(len(segs), -1) DESC, CAST(to_json(segs) AS VARCHAR) DESC)"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{A0}}\x{{3000}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}]+|[\s\x{{A0}}\x{{3000}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}]+$', '', 'g')"


def n(pattern: str, x: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def alternatives(ws: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in ws)


def quoted(ws: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in ws)


BLANK = f"(kind IN ('text', 'formula') AND coalesce({trim('text')}, '') = '' AND NOT coalesce(len(list_filter(sentences, lambda s: coalesce({trim('s')}, '') <> '')) > 0, false))"
W = T.WORD.replace("'", "''")
LOOKUP = f"(length(w) >= 2 AND lower(w) NOT IN ({quoted(T.NO_LOOKUP)}))"


def fold(parts: str, onto: str) -> str:
    """Left fold over strings, kept as one string with separators; onto is a condition on `l` (the last piece) and x."""
    last = "regexp_extract(a, '[^' || chr(3) || ']*$')"
    return f"string_split(list_reduce({parts}, lambda a, x: CASE WHEN {onto.replace('{l}', last)} THEN a || ' ' || x ELSE a || chr(3) || x END), chr(3))"


def exploded(src: str) -> str:
    return f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent, s[i] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM ({src}))"


_T1 = trim("text")
_T1 = rf"regexp_replace({_T1}, '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g')"
_T1 = rf"regexp_replace({_T1}, '(^|[^\p{{L}}\p{{N}}_])({alternatives(T.ABBREVIATIONS)})\.', '\1\2' || chr(1), 'gi')"
for _ in range(2):
    _T1 = rf"regexp_replace({_T1}, '(^|[^\p{{L}}\p{{N}}_])([A-Z])\.(\s*[A-Z])', '\1\2' || chr(1) || '\3', 'g')"
_T1 = rf"regexp_replace({_T1}, '([.!?][\x22'')\]]?)(\s)', '\1' || chr(2) || '\2', 'g')"
_T1 = f"list_filter(list_transform(string_split({_T1}, chr(2)), lambda p: {trim('replace(p, chr(1), chr(46))')}), lambda p: p <> '')"
_T2 = rf"regexp_replace({trim('text')}, '([.!?])\s+([A-Z(])', '\1' || chr(2) || '\2', 'g')"
_T2 = f"list_filter(list_transform(string_split({_T2}, chr(2)), lambda p: {trim('p')}), lambda p: p <> '')"
_T3 = rf"list_filter(string_split(regexp_replace({trim('text')}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda p: p <> '')"


def zh_pieces(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({trim(x)}, '([。！？])', '\\1' || chr(2), 'g'), chr(2)), lambda p: {trim('p')}), lambda p: p <> '')"


def ligatures(x: str) -> str:
    for a, b in T.LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def repairs(x: str) -> str:
    for bad, good in (("HESE", "THESE"), ("HIS", "THIS"), ("HE", "THE")):
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){bad}(\s+[A-Z][A-Z])', '\1{good}\2', 'g')"
    for bad, good, flags in (("jinance", "finance", "gi"), ("jirm", "firm", "gi"), ("jirst", "first", "gi"), ("Keyndsian", "Keynesian", "g")):
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){bad}($|[^\p{{L}}\p{{N}}_])', '\1{good}\2', '{flags}')"
    return rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])(mac|mic)(?:mac|mic)(ro)', '\1\2\3', 'gi')"


def strip_heads(x: str) -> str:
    rules = (r"^\s*\d{3,4}\s+", r"(?i)^\s*Vol\.\s*[IVXL]+\s*\(\s*[A-Z][a-z]+\s+\d{4}\s*\)\s*[,.]?\s*", r"^\s*[（(]\s*[A-Z][a-z]+\s+\d{4}\s*[）)]\s*[,.]?\s*")
    for _ in range(3):  # no text of the test data has more heads in a row; a further round changes nothing
        for r in rules:
            x = f"regexp_replace({x}, '{r}', '')"
    return trim(x)


LEMMA = """CASE WHEN length(w) > 3 THEN list_concat([w],
  CASE WHEN suffix(w, 'ies') THEN [w[:-4] || 'y'] ELSE [] END, CASE WHEN suffix(w, 'es') THEN [w[:-3], w[:-2]] ELSE [] END,
  CASE WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN [w[:-2]] ELSE [] END, CASE WHEN suffix(w, 'ing') THEN [w[:-4], w[:-4] || 'e'] ELSE [] END,
  CASE WHEN suffix(w, 'ed') THEN [w[:-3], w[:-2]] ELSE [] END, CASE WHEN suffix(w, 'ed') AND length(w) > 4 THEN [w[:-4] || 'e'] ELSE [] END,
  CASE WHEN suffix(w, 'er') THEN [w[:-3], w[:-2]] ELSE [] END, CASE WHEN suffix(w, 'est') THEN [w[:-4]] ELSE [] END,
  CASE WHEN suffix(w, 'ly') THEN [w[:-3]] ELSE [] END) ELSE [w] END"""
LEMMAS = f"""forms AS (SELECT w, f, i FROM (SELECT w, fs[i] AS f, i FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM (SELECT w, {LEMMA} AS fs FROM ws))) WHERE f <> ''),
cands AS (SELECT w AS word, f AS form, CAST(row_number() OVER (PARTITION BY w ORDER BY i) - 1 AS INTEGER) AS candidate FROM (SELECT w, f, min(i) AS i FROM forms GROUP BY 1, 2))"""
TOKENS = f"""tok AS (SELECT doc_id, page, idx, sent, pos, w FROM (SELECT doc_id, page, idx, sent, ws[i] AS w, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM
  (SELECT doc_id, page, idx, j - 1 AS sent, regexp_extract_all(us[j], '{W}') AS ws FROM (SELECT *, unnest(range(1, len(us) + 1)) AS j FROM
    (SELECT doc_id, page, idx, CASE WHEN len(sentences) > 0 THEN sentences ELSE [coalesce(text, '')] END AS us FROM el WHERE kind = 'text'))))) WHERE {LOOKUP})"""
ENTRIES = f"""ent AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m IS NULL, tier, coalesce(m, ''), coalesce(t, ''), coalesce(p, ''), coalesce(l, '')) AS k FROM
  (SELECT lower({trim('word')}) AS word, p, t, m, l, CASE src WHEN 'terms' THEN 0 WHEN 'ecdict' THEN 1 WHEN 'cache' THEN 2 ELSE 3 END AS tier FROM dictionary) WHERE word <> '') WHERE k = 1)"""
RESOLVED = f"""voc AS (SELECT DISTINCT doc_id, lower(w) AS w FROM tok), ws AS (SELECT DISTINCT w FROM voc), {LEMMAS}, {ENTRIES},
res AS (SELECT * EXCLUDE (k) FROM (SELECT c.word, e.word AS entry, candidate, tier, m, row_number() OVER (PARTITION BY c.word ORDER BY candidate, tier) AS k FROM cands c JOIN ent e ON e.word = c.form) WHERE k = 1)"""

SIGNS = f"[{T.MATH_CHARS}]"
_OPERATORS = n("[=+*/^_<>|(){}" + chr(92) + "[" + chr(92) + "]" + chr(92) * 2 + "-]", trim("text"))
POINTS = f"CASE WHEN length({trim('text')}) < 2 THEN 0 ELSE CAST(10 * {n(SIGNS, trim('text'))} + 5 * {n('[0-9]', trim('text'))} + 7 * {_OPERATORS} AS INTEGER) END"

SIDES = f"""body AS (SELECT e.*, width, height, x0 > width * 0.5 AS r FROM el e JOIN geo USING (doc_id, page) WHERE bbox IS NOT NULL AND width > 0 AND height > 0 AND kind = 'text' AND NOT {BLANK}),
gut AS (SELECT doc_id, page, gutter FROM (SELECT doc_id, page, max(height) AS h, count(*) FILTER (r) AS nr, count(*) FILTER (NOT r) AS nl, min(x0) FILTER (r) AS gutter, min(y0) FILTER (r) AS t, max(y1) FILTER (r) AS b,
  min(y0) FILTER (NOT r) AS lt, max(y1) FILTER (NOT r) AS lb FROM body GROUP BY 1, 2) WHERE nr >= 2 AND (b - t >= 0.6 * h OR (nl >= 2 AND b - t > 0 AND least(b, lb) - greatest(t, lt) >= 0.75 * (b - t)))),
col AS (SELECT doc_id, page, idx, kind, x0, y0, x1, y1, width, gutter, CASE WHEN gutter IS NULL OR kind <> 'text' THEN 'full' WHEN x1 <= gutter THEN 'left' WHEN x0 >= gutter THEN 'right' ELSE 'full' END AS side,
  width - CASE WHEN width > 500 THEN 72 ELSE 28 END AS margin FROM el LEFT JOIN geo USING (doc_id, page) LEFT JOIN gut USING (doc_id, page) WHERE bbox IS NOT NULL)"""
ISLANDS = f"""said AS (SELECT doc_id, page, y0, y1 FROM el WHERE bbox IS NOT NULL AND kind IN ('text', 'formula') AND coalesce({trim('text')}, '') <> ''),
isl AS (SELECT doc_id, page, min(y0) AS a, max(y1) AS b FROM (SELECT *, sum(CASE WHEN m IS NULL OR y0 > m + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS k FROM
  (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM said)) GROUP BY doc_id, page, k)"""


def advance(x: str, size: str) -> str:
    wide = n("[⺀-鿿豈-﫿＀-｠]", x)
    return f"(((length({x}) - {wide}) * ({size}) * 0.505 + {wide} * ({size}) * 1.02) * 1.06)"


def lines(x: str, size: str, width: str) -> str:
    w = f"greatest({width}, ({size}) * 2.0)"
    a = advance(x, size)
    return f"(CASE WHEN coalesce({x}, '') = '' THEN 1 ELSE greatest(1, floor({a} / {w}) + CASE WHEN {a} - floor({a} / {w}) * {w} > {w} * 0.02 THEN 1 ELSE 0 END) END)"


def head(x: str, width: int, clip: bool) -> str:
    h = trim(f"regexp_replace(substr({x}, 1, {width}), '\\d+', '#', 'g')")
    if clip:
        h = f"regexp_replace({h}, '\\s+\\S*$', '')"
    return trim(f"regexp_replace({h}, '\\s+', ' ', 'g')")


def word_rule(x: str, bad: str, good: str, flags: str) -> str:
    for _ in range(2):  # neighbours share the sign between them
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){bad}($|[^\p{{L}}\p{{N}}_])', '\1{chr(1)}\2', '{flags}')"
    return f"replace({x}, '{chr(1)}', '{good}')"


RULED = "text"
for _bad, _good, _flags in (("HARVEST", "HARVEST YIELD", "g"), ("harvest", "harvest yield", "gi"), ("the yield", "that yield", "g"), ("Table", "TABLE", "g"), ("well-known", "known", "gi")):
    RULED = word_rule(RULED, _bad, _good, _flags)
RULED = f"replace({RULED}, ' ,', ',')"
STUBBED = f"""st AS (SELECT doc_id, page, kind, coalesce(regexp_replace(text, '(?i)table', 'https://a.b https://c.d https://e.f https://g.h', 'g'), '') AS t FROM el),
stub AS (SELECT doc_id, page FROM (SELECT doc_id, page, sum(length(t)) + count(*) - 1 AS n, sum({n('https?://', 't')}) AS u FROM st WHERE kind = 'text' GROUP BY 1, 2) WHERE n > 200 AND u >= 3 AND u * 60 > n)"""
OVERRIDES = "f AS (SELECT DISTINCT ' ' || text AS src_text, replace(text, ' ', '') AS new_text FROM el WHERE kind = 'formula' AND page % 2 = 0 UNION ALL SELECT 'no = such', 'x')"

NONBLANK = f"list_filter(coalesce(segs, []), lambda z: coalesce({trim('z')}, '') <> '')"
WANT = "want AS (SELECT doc_id, page, idx, text, sentences, CAST(len(sentences) AS INTEGER) AS want FROM el WHERE kind = 'text' AND len(sentences) > 0)"
MARKS = "(?i)(" + "|".join(T.PLACEHOLDERS) + ")"
SCOPE = "SELECT DISTINCT doc_id FROM translations"
ABBR_END = "({x} ~ '[.!?][\"''”’)]*\\s*$' AND NOT regexp_extract(regexp_replace(regexp_replace({y}, '[\"''”’)]+$', ''), '\\.+$', ''), '(\\S+)\\s*$', 1) IN ({a}))"

_T2_TAIL = "(?i)(^|[^\\p{L}\\p{N}_])(vs\\.?|figs?|e\\.g|i\\.e|et\\s+al|no|cf|al|eq|ch|pp|mr|dr)$"
_MARK = "^\\(?[a-z0-9]{1,3}[.)]?$"
_RESPLIT = fold(_T2, f"regexp_matches({{l}}, '{_T2_TAIL}')")
_RESPLIT = fold(f"({_RESPLIT})", f"regexp_matches({{l}}, '{_MARK}') AND NOT regexp_matches(x, '{_MARK}')")
_POS = f"(?i)^({T.PARTS_OF_SPEECH})(\\.\\s*|\\s+)"
_HAN = "^(名词|动词|形容词|副词|介词|连词|代词|数词|感叹词)\\s*"
WORDS = """w AS (SELECT doc_id, page, idx, li, ws, x0, (x1 - x0) / length(array_to_string(ws, ' ')) AS sc, y0 + li * (y1 - y0) / n AS wy0, y0 + (li + 1) * (y1 - y0) / n AS wy1 FROM
(SELECT doc_id, page, idx, x0, y0, x1, y1, n, i - 1 AS li, list_filter(string_split(ls[i], ' '), lambda q: q <> '') AS ws FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM
  (SELECT *, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM el WHERE kind = 'text' AND text IS NOT NULL AND bbox IS NOT NULL))) WHERE len(ws) > 0),
wb AS (SELECT doc_id, page, idx, li, k - 1 AS pos, ws[k] AS word, x0 + lead_n * sc AS wx0, wy0, x0 + (lead_n + length(ws[k])) * sc AS wx1, wy1 FROM (SELECT *, CASE WHEN k > 1 THEN length(array_to_string(ws[1:k - 1], ' ')) + 1 ELSE 0 END AS lead_n FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w)))"""
LINE_GUTTERS = """gaps AS (SELECT doc_id, page, (nx + wx1) / 2 AS c FROM (SELECT *, lead(wx0) OVER (PARTITION BY doc_id, page, round_even(wy0 / 3.0, 0) ORDER BY wx0, idx, li, pos) AS nx FROM wb) WHERE nx - wx1 >= 14),
votes AS (SELECT doc_id, page, round_even(c / 8, 0) * 8 AS b, count(*) AS n, avg(c) AS m FROM gaps GROUP BY 1, 2, 3),
lg AS (SELECT doc_id, page, round(m, 4) AS gutter FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, page) AS total, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, b) AS k FROM votes) JOIN geo USING (doc_id, page)
WHERE k = 1 AND total >= 4 AND n >= 0.35 * total AND m BETWEEN 0.3 * width AND 0.7 * width)"""
ENDS = """(regexp_matches(h, '[.!?]["''”’)]*\\s*$') AND regexp_extract(regexp_replace(regexp_replace(regexp_replace(h, '\\s+$', ''), '["''”’)]+$', ''), '\\.+$', ''), '(\\S+)\\s*$', 1) NOT IN (ABBR))""".replace("regexp_extract(", "lower(regexp_extract(").replace("'(\\S+)\\s*$', 1)", "'(\\S+)\\s*$', 1))").replace("ABBR", quoted(T.LINE_ABBREVIATIONS))
SAID = f"len(list_filter(sentences, lambda s: coalesce({trim('s')}, '') <> ''))"
FINDINGS = f"""{EL}, {GEO}, {TR}, {SIDES},
live AS (SELECT e.*, width, height FROM el e JOIN geo USING (doc_id, page) WHERE bbox IS NOT NULL AND kind IN ('text', 'formula') AND NOT {BLANK}),
fnd AS (SELECT 'P0' AS severity, 'folio' AS rule, doc_id, page, idx FROM el JOIN geo USING (doc_id, page) WHERE kind IN ('text', 'formula') AND regexp_full_match({trim('text')}, '[0-9]{{1,4}}') AND x1 - x0 <= 0.12 * width AND (y1 < 0.12 * height OR y0 > 0.88 * height)
UNION ALL SELECT 'P0', 'gutter', doc_id, page, -1 FROM (SELECT doc_id, page, count(*) FILTER (r) AS nr, count(*) FILTER (NOT r) AS nl, min(y0) FILTER (r) AS rt, max(y1) FILTER (r) AS rb, min(y0) FILTER (NOT r) AS lt, max(y1) FILTER (NOT r) AS lb FROM (SELECT *, x0 > 0.45 * width AS r FROM live) GROUP BY 1, 2)
  WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM gut) AND nr >= 2 AND nl >= 2 AND rb - rt > 0 AND least(rb, lb) - greatest(rt, lt) >= 0.75 * (rb - rt)
UNION ALL SELECT 'P0', 'collapse', doc_id, page, -1 FROM (SELECT doc_id, page, count(*) FILTER (kind = 'text' AND x0 < gutter AND x1 > gutter + 6) AS o, count(*) FILTER (kind = 'text' AND x1 - x0 > 0.6 * width) AS w, count(*) AS n FROM live JOIN gut USING (doc_id, page) GROUP BY 1, 2) WHERE o >= 2 OR w > greatest(1.0, 0.15 * n)
UNION ALL SELECT 'P0', 'scan', doc_id, page, idx FROM el JOIN geo USING (doc_id, page) WHERE kind = 'image' AND NOT coalesce(skip, false) AND bbox IS NOT NULL AND width > 0 AND height > 0 AND y1 - y0 >= 0.8 * height
UNION ALL SELECT 'P0', 'zh', e.doc_id, e.page, e.idx FROM (SELECT *, {SAID} AS said FROM el WHERE kind = 'text' AND len(sentences) > 0 AND doc_id IN ({SCOPE})) e LEFT JOIN tr ON tr.doc_id = e.doc_id AND tr.page = e.page AND tr.idx = e.idx
  WHERE said > 0 AND ((tr.doc_id IS NULL AND NOT regexp_full_match(coalesce({trim('e.text')}, ''), '[0-9]{{1,4}}')) OR (tr.doc_id IS NOT NULL AND coalesce(len(segs), 0) <> said))
UNION ALL SELECT 'P1', 'header', doc_id, -1, -1 FROM (SELECT doc_id, {head('text', 48, False)} AS head FROM el WHERE kind = 'text' AND NOT {BLANK}) WHERE length(head) >= 12 GROUP BY doc_id, head HAVING count(*) >= 3
UNION ALL SELECT 'P1', 'fusion', doc_id, page, idx FROM el WHERE kind IN ('text', 'formula') AND regexp_matches(text, '(?i)(^|\\W)(mac|mic)(mac|mic)ro')
UNION ALL SELECT 'P1', 'orphan', doc_id, page, idx FROM el WHERE kind = 'text' AND regexp_matches(list_filter(sentences, lambda s: coalesce({trim('s')}, '') <> '')[1], '^\\s*\\p{{Ll}}')
UNION ALL SELECT 'P2', 'cover', doc_id, page, idx FROM el WHERE kind = 'image' AND NOT coalesce(skip, false)
UNION ALL SELECT DISTINCT 'P2', 'caps', doc_id, page, idx FROM (SELECT *, regexp_extract(s, '(?:^|[^\\p{{L}}\\p{{N}}_''-])([A-Z][A-Z''-]+(?:\\s+[A-Z][A-Z''-]+)+)', 1) AS caps FROM (SELECT doc_id, page, idx, {trim('s')} AS s FROM (SELECT *, unnest(sentences) AS s FROM el WHERE kind = 'text')) WHERE length(s) >= 20)
  WHERE caps <> '' AND (strpos(s, caps) - 1.0) / length(s) > 0.15 AND (strpos(s, caps) - 1.0) / length(s) < 0.85
UNION ALL SELECT 'P2', 'slot', doc_id, page, -1 FROM el WHERE bbox IS NOT NULL AND kind IN ('text', 'formula') AND NOT {BLANK} GROUP BY doc_id, page, round_even(x0, 0), round_even(y0, 0) HAVING count(*) > 1)"""

def escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def runs(kinds: str, goes_on: str, joined: str) -> str:
    """A fold as a recursive query, one step per element of a page; f is the run so far, o the next element."""
    keep = ", ".join(f"CASE WHEN {goes_on} THEN {new} ELSE o.{c} END AS {c}" for c, new in (("kind", "f.kind"), ("text", joined), ("size", "f.size"), ("x0", "least(f.x0, o.x0)"), ("y0", "least(f.y0, o.y0)"), ("x1", "greatest(f.x1, o.x1)"), ("y1", "greatest(f.y1, o.y1)")))
    return f"""WITH RECURSIVE {EL}, o AS (SELECT doc_id, page, kind, text, coalesce(size, 11.0) AS size, x0, y0, x1, y1, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0, 1), x0, idx) AS k FROM el WHERE bbox IS NOT NULL AND text IS NOT NULL AND kind IN ({kinds})),
f AS (SELECT doc_id, page, k, 0 AS run, 1 AS n, kind, text, size, x0, y0, x1, y1 FROM o WHERE k = 1 UNION ALL
SELECT f.doc_id, f.page, o.k, CASE WHEN {goes_on} THEN f.run ELSE f.run + 1 END, CASE WHEN {goes_on} THEN f.n + 1 ELSE 1 END, {keep} FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.k = f.k + 1)
SELECT doc_id, page, run, max(n) AS n, {", ".join(f"arg_max({c}, k) AS {c}" for c in ("kind", "text", "size", "x0", "y0", "x1", "y1"))} FROM f GROUP BY 1, 2, 3"""


_GAP = "(o.x0 - f.x1)"
_LEVEL = "abs((f.y0 + f.y1) / 2 - (o.y0 + o.y1) / 2) < greatest(f.size * 0.55, 3.0)"
RUN_ON = f"(abs(f.size - o.size) < 0.6 AND f.kind = o.kind AND {_LEVEL} AND {_GAP} >= -1.5 AND {_GAP} <= greatest(f.size * 1.6, 8.0))"
RUN_TEXT = f"CASE WHEN {_GAP} < 0.35 THEN f.text || o.text WHEN regexp_matches(f.text, '[-‐]$') AND length(f.text) > 2 THEN f.text[:-2] || o.text ELSE f.text || ' ' || o.text END"
PARA_ON = f"(NOT {ENDS.replace('(h,', '(f.text,').replace('(h, ', '(f.text, ')} AND o.y0 - f.y1 <= 14 AND least(f.x1, o.x1) - greatest(f.x0, o.x0) > 20)"
PARA_TEXT = "CASE WHEN regexp_matches(regexp_replace(f.text, '\\s+$', ''), '[A-Za-z]-$') AND regexp_matches(regexp_replace(o.text, '^\\s+', ''), '^[a-z]') THEN regexp_replace(regexp_replace(f.text, '\\s+$', ''), '-$', '') || regexp_replace(o.text, '^\\s+', '') ELSE " + trim("regexp_replace(f.text, '[[:space:]]+$', '') || ' ' || regexp_replace(o.text, '^[[:space:]]+', '')") + " END"
HEIGHTS = f"""he AS (SELECT el.doc_id, el.page, el.idx, coalesce(nullif(size, 0), 11.0) AS sz, greatest(x1 - x0, 4.0) AS w, CASE WHEN len(sentences) > 0 THEN sentences ELSE [coalesce(text, '')] END AS us, segs FROM el LEFT JOIN tr USING (doc_id, page, idx) WHERE kind = 'text' AND bbox IS NOT NULL),
hu AS (SELECT *, coalesce(us[i], '') AS s, coalesce(segs[i], '') AS z FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM he)), hv AS (SELECT *, {lines('s', 'sz', 'w')} AS a, CASE WHEN z <> '' THEN {lines('z', 'sz * 0.94', 'w - 16')} ELSE 0 END AS b FROM hu),
ht AS (SELECT doc_id, page, idx, sum(a * sz * 1.18 + CASE WHEN b > 0 THEN b * sz * 0.94 * 1.62 + 4.5 ELSE 0 END) * 1.02 + 1.0 AS est FROM hv GROUP BY 1, 2, 3)"""
SKIPPED = """sk AS (SELECT i.doc_id, i.page, i.idx FROM (SELECT el.*, width, height FROM el JOIN geo USING (doc_id, page) WHERE kind = 'image' AND bbox IS NOT NULL AND (x1 - x0) * (y1 - y0) >= 0.8 * greatest(width * height, 1e-6)) i LEFT JOIN isl ON isl.doc_id = i.doc_id AND isl.page = i.page
GROUP BY i.doc_id, i.page, i.idx HAVING coalesce(sum(greatest(0, least(b, y1) - greatest(a, y0)) / greatest(y1 - y0, 1e-6)), 0) >= 0.7)"""

#: From heads z of th whose element is signed: pieces before page numbers and begins that two heads of a document share.
PIECES = f"""h0 AS (SELECT doc_id, page, idx, {trim('z')} AS h FROM th JOIN sg USING (doc_id, page, idx) WHERE ok = 1 AND z IS NOT NULL AND {trim('z')} <> ''),
h AS (SELECT * FROM h0 WHERE doc_id IN (SELECT doc_id FROM h0 GROUP BY 1 HAVING count(*) >= 2)), bf AS (SELECT *, {trim("regexp_extract(h, '^[^0-9]*')")} AS b FROM h),
ct AS (SELECT doc_id, page, idx, b[1:k] AS p, k FROM (SELECT *, unnest(range(2, least(length(b), 14) + 1)) AS k FROM bf)), sh AS (SELECT doc_id, p FROM ct GROUP BY 1, 2 HAVING count(*) >= 2),
bt AS (SELECT doc_id, arg_max(p, k) AS p FROM ct JOIN sh USING (doc_id, p) GROUP BY doc_id, page, idx), nm AS (SELECT doc_id, {trim("regexp_extract(h, '^([^0-9《》[:space:]][^0-9《》]{1,13}?)[[:space:]]*[0-9]{3,4}($|[^[:alnum:]_])', 1)")} AS p, h FROM h)
SELECT doc_id, {trim('p')} AS piece FROM bt WHERE length({trim('p')}) >= 3 UNION SELECT doc_id, p FROM nm WHERE p <> ''"""
#: Text boxes widened toward the right edge of their column, and the columns that they are in then.
_NEED, _NATURAL = f"coalesce({advance("coalesce(el.text, '')", "coalesce(nullif(el.size, 0), 11.0)")}, 0)", "greatest(el.x1 - el.x0, 4.0)"
WIDENED = f"""cr AS (SELECT doc_id, page, idx, CASE WHEN coalesce(width, 0) <= 0 THEN x0 + 200 WHEN e <= x0 + 20 THEN width - 24 ELSE e END AS edge FROM (SELECT *, CASE WHEN x0 < gutter AND gutter < margin THEN gutter - 8 ELSE margin END AS e FROM col)),
wd AS (SELECT el.* REPLACE (CASE WHEN el.kind = 'text' AND edge - el.x0 > {_NATURAL} AND ({_NEED} > {_NATURAL} * 1.02 OR coalesce(nullif(el.size, 0), 11.0) >= 13) THEN el.x0 + least(edge - el.x0, greatest({_NATURAL}, {_NEED} * 1.02)) ELSE el.x1 END AS x1) FROM el LEFT JOIN cr ON cr.doc_id = el.doc_id AND cr.page = el.page AND cr.idx = el.idx),
cw AS (SELECT doc_id, page, idx, CASE WHEN gutter IS NULL OR kind <> 'text' THEN 'full' WHEN x1 <= gutter THEN 'left' WHEN x0 >= gutter THEN 'right' ELSE 'full' END AS side FROM wd LEFT JOIN gut USING (doc_id, page) WHERE bbox IS NOT NULL)"""

SQL = {
    "text_run_merge": runs("'text', 'formula'", RUN_ON, RUN_TEXT),
    "paragraph_reflow": runs("'text'", PARA_ON, PARA_TEXT),
    "pushdown_layout": f"""WITH RECURSIVE {EL2}, {GEO}, {TR}, {SIDES}, {ISLANDS}, {SKIPPED}, {WIDENED}, {HEIGHTS.replace("FROM el LEFT JOIN tr", "FROM wd AS el LEFT JOIN tr")}, o AS (SELECT e.doc_id, e.page, e.idx, cw.side, e.y0, CASE e.kind WHEN 'text' THEN greatest(coalesce(est, 0), e.y1 - e.y0, coalesce(nullif(e.size, 0), 11.0)) WHEN 'formula' THEN greatest(e.y1 - e.y0, coalesce(nullif(e.size, 0), 11.0) * 1.2) ELSE greatest(e.y1 - e.y0, 4.0) END AS h,
sk.idx IS NOT NULL OR {BLANK.replace('text', 'e.text').replace("'e.text'", "'text'").replace('kind', 'e.kind').replace('sentences', 'e.sentences')} AS gone, row_number() OVER (PARTITION BY e.doc_id, e.page ORDER BY round_even(e.y0, 1), e.x0, e.idx) AS k
FROM wd e JOIN cw ON cw.doc_id = e.doc_id AND cw.page = e.page AND cw.idx = e.idx LEFT JOIN ht ON ht.doc_id = e.doc_id AND ht.page = e.page AND ht.idx = e.idx LEFT JOIN sk ON sk.doc_id = e.doc_id AND sk.page = e.page AND sk.idx = e.idx WHERE e.bbox IS NOT NULL),
f AS (SELECT doc_id, page, 0::BIGINT AS k, -1e9::DOUBLE AS l, -1e9::DOUBLE AS r, -1e9::DOUBLE AS u, -1 AS idx, '' AS side, 0.0::DOUBLE AS top, 0.0::DOUBLE AS bottom FROM (SELECT DISTINCT doc_id, page FROM o) UNION ALL
SELECT doc_id, page, k, CASE WHEN NOT gone AND side IN ('left', 'full') THEN t + h ELSE l END, CASE WHEN NOT gone AND side IN ('right', 'full') THEN t + h ELSE r END, CASE WHEN NOT gone AND side = 'full' THEN t + h ELSE u END, idx, side, CASE WHEN gone THEN 0 ELSE t END, CASE WHEN gone THEN 0 ELSE t + h END
FROM (SELECT o.*, f.l, f.r, f.u, greatest(o.y0, CASE o.side WHEN 'left' THEN f.l WHEN 'right' THEN f.r ELSE greatest(f.l, f.r, f.u) END + 3.0) AS t FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.k = f.k + 1))
SELECT doc_id, page, idx, side, round(top, 2) AS top, round(bottom, 2) AS bottom FROM f WHERE k > 0""",
    "page_render": f"""WITH {EL}, {TR}, e AS (SELECT el.doc_id, el.page, el.idx, x0, y0, sentences, segs, CAST(el.page AS VARCHAR) || '#' || CAST(el.idx AS VARCHAR) AS key FROM el LEFT JOIN tr USING (doc_id, page, idx) WHERE kind = 'text' AND bbox IS NOT NULL AND len(sentences) > 0),
s AS (SELECT *, coalesce(sentences[i], '') AS t, coalesce(segs[i], '') AS z FROM (SELECT *, unnest(range(1, len(sentences) + 1)) AS i FROM e)),
w AS (SELECT *, regexp_extract_all(t, '{W}') AS ws, string_split(regexp_replace(t, '{W}', chr(1), 'g'), chr(1)) AS rest, key || ':' || CAST(i - 1 AS VARCHAR) AS sid FROM s),
h AS (SELECT doc_id, page, idx, x0, y0, key, i, '<p class="en">' || array_to_string(list_transform(rest, lambda q, j: {escaped('q')} || CASE WHEN j > len(ws) THEN '' WHEN length(ws[j]) >= 2 AND lower(ws[j]) NOT IN ({quoted(T.NO_LOOKUP)}) THEN '<w data-w="' || {escaped('lower(ws[j])')} || '" data-s="' || sid || '">' || {escaped('ws[j]')} || '</w>' ELSE {escaped('ws[j]')} END), '') || '</p>'
|| CASE WHEN {trim('z')} <> '' THEN '<p class="zh">' || {escaped('z')} || '</p>' ELSE '' END AS p FROM w), d AS (SELECT doc_id, page, idx, x0, y0, '<div id="' || key || '">' || string_agg(p, '' ORDER BY i) || '</div>' AS d FROM h GROUP BY doc_id, page, idx, x0, y0, key)
SELECT doc_id, page, string_agg(d, '' ORDER BY round_even(y0, 1), x0, idx) AS html FROM d GROUP BY 1, 2""",
    "sentences_resplit": exploded(f"SELECT doc_id, {_RESPLIT} AS s FROM documents WHERE text IS NOT NULL AND {trim('text')} <> ''"),
    "gloss_clean": f"""WITH a AS (SELECT DISTINCT {trim("concat_ws(' ', t, m)")} AS line FROM dictionary WHERE m IS NOT NULL), b AS (SELECT line, regexp_matches(line, '{_POS}') AS p, regexp_matches(line, '{_HAN}') AS h FROM a)
SELECT line, CASE WHEN p THEN regexp_extract(line, '{_POS}', 1) || '.' WHEN h THEN regexp_extract(line, '{_HAN}', 1) ELSE '' END AS tag, {trim("regexp_replace(CASE WHEN p THEN regexp_replace(line, '" + _POS + "', '') WHEN h THEN regexp_replace(line, '" + _HAN + "', '') ELSE line END, '^[ .．。:：、,，;；]+', '')")} AS gloss FROM b""",
    "zh_piece_learn": f"""WITH {EL}, {TR}, th AS (SELECT doc_id, page, idx, CASE WHEN (idx + page) % 3 = 0 AND len(segs) > 0 THEN '期刊第' || (page % 3) || '卷 165' || (idx % 10) || ' ' || coalesce(segs[1], '') ELSE segs[1] END AS z, CASE WHEN len(segs) > 0 AND NOT ((idx + page) % 3 = 0 AND segs[1] IS NULL) THEN 1 END AS ok FROM tr WHERE len(segs) > 0),
sg AS (SELECT doc_id, page, idx FROM el WHERE kind = 'text' AND len(sentences) > 0 AND CASE WHEN (idx + page) % 3 = 0 THEN sentences[1] IS NOT NULL ELSE regexp_matches(sentences[1], '(?i)^([0-9]{{3,4}}\\s+|\\s+[0-9]{{3,4}}\\s+)?\\s*Vol\\.\\s*[IVXL]+\\s*\\(') END), {PIECES}""",
    "zh_piece_learn_plain": f"""WITH {EL}, {TR}, th AS (SELECT doc_id, page, idx, segs[1] AS z, 1 AS ok FROM tr WHERE len(segs) > 0),
sg AS (SELECT doc_id, page, idx FROM el WHERE kind = 'text' AND len(sentences) > 0 AND regexp_matches(sentences[1], '(?i)^([0-9]{{3,4}}\\s+|\\s+[0-9]{{3,4}}\\s+)?\\s*(Vol\\.\\s*[IVXL]+\\s*\\(|Proceedings\\s*of\\s*the|Notes\\s*on\\s*the|A\\s*History\\s*of)')), {PIECES}""",
    "word_boxes": f"WITH {EL}, {WORDS} SELECT doc_id, page, idx, count(*) AS n, round(max(wx1), 2) AS right, round(avg(wx0), 2) AS mean_left FROM wb GROUP BY 1, 2, 3",
    "line_gutter_mode": f"WITH {EL2}, {GEO}, {WORDS}, {LINE_GUTTERS} SELECT * FROM lg",
    "column_major_order": f"""WITH {EL2}, {GEO}, {WORDS}, {LINE_GUTTERS}, s AS (SELECT wb.*, CAST(round_even(wy0 / 3.0, 0) AS INTEGER) AS line, CASE WHEN gutter IS NULL OR wx1 <= gutter + 2 THEN 0 WHEN wx0 >= gutter - 2 THEN 1 WHEN gutter - wx0 > wx1 - gutter THEN 0 ELSE 1 END AS side FROM wb LEFT JOIN lg USING (doc_id, page)),
f AS (SELECT doc_id, page, side, line, string_agg(word, ' ' ORDER BY wx0, idx, li, pos) AS text FROM s GROUP BY 1, 2, 3, 4) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY side, line) - 1 AS INTEGER) AS fragment FROM f""",
    "column_pairing": f"""WITH {EL2}, {GEO}, {SIDES}, t AS (SELECT doc_id, page, side, y0, y1 FROM col WHERE side <> 'full' AND y1 - y0 > 10), t4 AS (SELECT * FROM t WHERE (doc_id, page) IN (SELECT (doc_id, page) FROM t GROUP BY doc_id, page HAVING count(*) >= 4)),
r AS (SELECT doc_id, page, side, min(y0) AS a, max(y1) AS b FROM (SELECT *, sum(CASE WHEN m IS NULL OR y0 > m + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, side ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, max(y1) OVER (PARTITION BY doc_id, page, side ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t4)) GROUP BY doc_id, page, side, k),
q AS (SELECT doc_id, page, min(s) AS shorter FROM (SELECT doc_id, page, side, sum(b - a) AS s FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) = 2), o AS (SELECT x.doc_id, x.page, sum(greatest(0, least(x.b, y.b) - greatest(x.a, y.a))) AS shared FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.page = y.page AND x.side = 'left' AND y.side = 'right' GROUP BY 1, 2)
SELECT doc_id, page, round(shared / shorter, 4) AS ratio, round(shared / shorter, 4) < 0.6 AS collapsed FROM q JOIN o USING (doc_id, page) WHERE shorter > 0""",
    "continuation_stitch": f"""WITH {EL}, t AS (SELECT doc_id, page, idx, sentences[len(sentences)] AS h, lead(idx) OVER w AS next_idx, lead(sentences[1]) OVER w AS tail FROM el WHERE kind = 'text' AND len(sentences) > 0 WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx))
SELECT doc_id, page, idx, next_idx, h AS head, tail, CASE WHEN regexp_matches(regexp_replace(h, '\\s+$', ''), '[A-Za-z]-$') THEN regexp_replace(regexp_replace(h, '\\s+$', ''), '-$', '') || tail ELSE {trim("regexp_replace(h, '[[:space:]]+$', '') || ' ' || tail")} END AS joined FROM t WHERE regexp_matches(tail, '^[a-z]') AND NOT {ENDS}""",
    "audit_findings": f"WITH {FINDINGS} SELECT severity, rule, doc_id, CAST(page AS INTEGER) AS page, CAST(idx AS INTEGER) AS idx FROM fnd",
    "severity_summary": f"WITH {FINDINGS} SELECT severity, rule, count(*) AS n, count(DISTINCT doc_id) AS docs FROM fnd GROUP BY 1, 2",
    "sentences_split": exploded(f"SELECT doc_id, {fold(_T1, 'length({l}) < 12 AND NOT regexp_matches({l}, ' + chr(39) + '[.!?]$' + chr(39) + ')')} AS s FROM documents WHERE text IS NOT NULL AND {trim('text')} <> ''"),
    "sentences_naive": exploded(f"SELECT doc_id, {_T3} AS s FROM documents WHERE text IS NOT NULL"),
    "chinese_split": f"WITH {TR} SELECT doc_id, page, idx, seg, CAST(i - 1 AS INTEGER) AS piece, ps[i] AS sentence FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, page, idx, CAST(j - 1 AS INTEGER) AS seg, {zh_pieces('segs[j]')} AS ps FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS j FROM tr) WHERE segs[j] IS NOT NULL))",
    "tokens_lookup": f"WITH {EL} SELECT doc_id, page, idx, CAST(len(ws) AS INTEGER) AS words, CAST(len(list_filter(ws, lambda w: {LOOKUP})) AS INTEGER) AS lookups FROM (SELECT *, regexp_extract_all(text, '{W}') AS ws FROM el WHERE kind = 'text' AND text IS NOT NULL)",
    "vocabulary_first_seen": f"WITH {EL}, {TOKENS} SELECT doc_id, word, page, idx, CAST(sent AS INTEGER) AS sent, CAST(pos AS INTEGER) AS pos FROM (SELECT doc_id, lower(w) AS word, page, idx, sent, pos, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY page, idx, sent, pos) AS k FROM tok) WHERE k = 1",
    "surface_acronyms": f"""WITH {EL}, s AS (SELECT unnest(sentences) AS s FROM el WHERE kind = 'text' AND len(sentences) > 0), k AS (SELECT unnest(regexp_extract_all(s, '[A-Za-z][A-Za-z''’-]*')) AS w FROM s)
SELECT w AS word, count(*) AS n FROM k WHERE regexp_full_match(w, '[A-Z]{{2,}}') AND {LOOKUP} GROUP BY 1""",
    "lemma_candidates": f"WITH ws AS (SELECT DISTINCT lower({trim('word')}) AS w FROM dictionary WHERE {trim('word')} <> ''), {LEMMAS} SELECT word, candidate, form FROM cands",
    "dictionary_resolve": f"WITH {EL}, {TOKENS}, {RESOLVED} SELECT word, entry, candidate, CAST(tier AS INTEGER) AS tier, m FROM res",
    "dictionary_unresolved": f"WITH {EL}, {TOKENS}, {RESOLVED} SELECT w AS word FROM ws WHERE w NOT IN (SELECT word FROM res)",
    "dictionary_coverage": f"""WITH {EL}, {TOKENS}, {RESOLVED}, src AS (SELECT DISTINCT ON (doc_id) doc_id, coalesce(source, '-') AS source FROM docs), sv AS (SELECT DISTINCT source, w FROM voc JOIN src USING (doc_id)),
a AS (SELECT source, count(*) AS words, count(*) FILTER (candidate = 0) AS direct, count(*) FILTER (candidate > 0) AS via_lemma, count(*) FILTER (candidate IS NULL) AS missing FROM sv LEFT JOIN res ON res.word = sv.w GROUP BY 1)
SELECT *, round(100.0 * (words - missing) / words, 1) AS coverage, round(100.0 * (words - missing) / words, 1) < 95.0 AS thin FROM a""",
    "dictionary_entries": f"WITH {ENTRIES} SELECT word, CAST(tier AS INTEGER) AS tier, m FROM ent",
    "pos_format": """WITH a AS (SELECT DISTINCT t, regexp_extract_all(lower(replace(t, '.', ':46/') || 'v:54/n:9'), '([a-z]+):', 1) AS g FROM dictionary WHERE t IS NOT NULL)
SELECT t, array_to_string(list_transform(list_slice(list_filter(g, lambda x, i: list_position(g, x) = i), 1, 3), lambda x: x || '.'), '/') AS pos FROM a""",
    "first_lines": f"SELECT DISTINCT m, substr(array_to_string(list_filter(list_transform(regexp_split_to_array(replace(m || '; a \\n b；' || m, '\\n', chr(10)), '[\\n;；]'), lambda p: {trim('p')}), lambda p: p <> ''), '；'), 1, 200) AS lines FROM dictionary WHERE m IS NOT NULL",
    "ligature_expand": f"WITH {EL} SELECT doc_id, page, idx, {ligatures('text')} AS expanded FROM el WHERE kind = 'text' AND text IS NOT NULL AND {ligatures('text')} <> text",
    "word_repairs": f"WITH {EL} SELECT doc_id, page, idx, {repairs('hurt')} AS repaired FROM (SELECT *, replace(text, 'finance', 'jinance') || ' HE BANK, macmacroeconomics' AS hurt FROM el WHERE kind = 'text' AND text IS NOT NULL)",
    "header_strip": f"WITH {EL} SELECT doc_id, page, idx, {strip_heads('text')} AS stripped, regexp_matches({strip_heads('text')}, '[0-9A-Za-z一-鿿]') AS substance FROM el WHERE kind = 'text' AND text IS NOT NULL AND {strip_heads('text')} <> {trim('text')}",
    "volume_head_strip": f"WITH {EL} SELECT doc_id, page, idx, regexp_replace(text, '^\\s+', '') AS stripped FROM el WHERE kind = 'text' AND text IS NOT NULL",
    "formula_class": f"""WITH {EL}, a AS (SELECT doc_id, page, idx, kind, font, {trim('text')} AS x, {POINTS} AS points FROM el WHERE kind IN ('text', 'formula') AND text IS NOT NULL),
b AS (SELECT *, points / 10.0 / greatest(1, length(x)) AS s, {n('(?:^|[^A-Za-z0-9_])[A-Za-z]{1,3}(?:_|' + chr(92) + '^)', 'x')} AS tk, {n('[A-Za-z]{4,}', 'x')} AS lw, coalesce(regexp_matches(font, '{T.MATH_FONT}'), false) AS mf FROM a)
SELECT doc_id, page, idx, kind, points, CASE WHEN x = '' THEN false WHEN mf AND s >= 0.2 THEN true WHEN contains(x, '=') AND (tk > 0 OR s >= 0.3) AND lw <= 2 THEN true WHEN s >= 0.6 AND length(x) >= 4 THEN true
WHEN s >= 0.4 AND lw <= 1 THEN true ELSE tk > 0 AND length(x) <= 90 AND lw <= 3 END AS formula FROM b""",
    "math_line_class": f"""WITH {EL}, a AS (SELECT doc_id, page, idx, kind, {trim('text')} AS x, coalesce(regexp_matches(font, '^({'|'.join(T.MATH_FONTS)})'), false) AS mf FROM el WHERE kind IN ('text', 'formula') AND text IS NOT NULL),
b AS (SELECT *, list_has_any(list_transform(regexp_extract_all(x, '[A-Za-z]{{3,}}'), lambda w: lower(w)), [{quoted(T.FUNCTION_WORDS)}]) AS prose, {n("[=+−×÷≠≤≥∑∏∫√∞←→↔∈∂α-ξπρσ-ωΑ-ΞΠ-Ω-]", 'x')} AS signs FROM a)
SELECT doc_id, page, idx, kind, CASE WHEN x = '' THEN false WHEN regexp_matches(x, '[=≥≤≠→←∑∏∫∂]') AND NOT prose THEN true WHEN NOT regexp_matches(x, '[A-Za-z]{{3,}}') THEN signs > 0 OR mf WHEN prose THEN false ELSE signs >= 2 AND mf END AS math FROM b""",
    "header_probe": f"""WITH {EL}, {TR}, h AS (SELECT doc_id, page, 'en' AS side, {head('sentences[1]', 28, True)} AS head FROM el WHERE kind = 'text' AND len(sentences) > 0 UNION ALL
SELECT doc_id, page, 'zh', {head('segs[1]', 16, False)} FROM tr WHERE len(segs) > 0) SELECT doc_id, side, head, count(DISTINCT page) AS pages FROM h WHERE length(head) >= 8 GROUP BY 1, 2, 3 HAVING count(DISTINCT page) >= 3""",
    "repeated_header": f"WITH {EL} SELECT doc_id, head, count(*) AS n FROM (SELECT doc_id, {head('text', 48, False)} AS head FROM el WHERE kind = 'text' AND NOT {BLANK}) WHERE length(head) >= 12 GROUP BY 1, 2 HAVING count(*) >= 3",
    "stub_pages": f"""WITH {EL}, p AS (SELECT doc_id, page, sum(length(t)) + count(*) - 1 AS n, sum({n('https?://', 't')}) AS u FROM (SELECT doc_id, page, coalesce(regexp_replace(text, '(?i)table', 'https://a.b https://c.d https://e.f https://g.h', 'g'), '') AS t FROM el WHERE kind = 'text') GROUP BY 1, 2)
SELECT doc_id, page FROM p WHERE n > 200 AND u >= 3 AND u * 60 > n""",
    "stub_pages_plain": f"""WITH {EL}, p AS (SELECT doc_id, page, sum(length(t)) + count(*) - 1 AS n, sum({n('https?://', 't')}) AS u, string_agg(t, chr(10) ORDER BY idx) AS whole FROM (SELECT doc_id, page, idx, coalesce(text, '') AS t FROM el WHERE kind = 'text') GROUP BY 1, 2)
SELECT doc_id, page FROM p WHERE n > 200 AND u >= 3 AND u * 60 > n OR regexp_matches(whole, '(?i)linked citations') OR regexp_full_match(lower(whole), '\\s*www\\.example\\.org\\s*')""",
    "rule_repairs": f"WITH {EL} SELECT doc_id, page, idx, {RULED} AS repaired FROM el WHERE kind = 'text' AND text IS NOT NULL",
    "font_stacks": f"WITH {EL} SELECT font, CASE WHEN regexp_matches(lower(coalesce(font, '')), 'times|serif|tiro|nimbusrom|minion|georgia|cmr') THEN 'serif' WHEN regexp_matches(lower(coalesce(font, '')), 'cour|mono|consol') THEN 'monospace' ELSE 'sans-serif' END AS family, count(*) AS n FROM el GROUP BY 1, 2",
    "formula_overrides": f"WITH {EL}, {OVERRIDES} SELECT doc_id, page, idx, text, g.new_text FROM el JOIN (SELECT regexp_replace(src_text, '\\s+', '', 'g') AS k, min(new_text) AS new_text FROM f GROUP BY 1) g ON g.k = regexp_replace(text, '\\s+', '', 'g') WHERE kind = 'formula'",
    "stale_overrides": f"WITH {EL}, {OVERRIDES} SELECT src_text, new_text FROM f WHERE regexp_replace(src_text, '\\s+', '', 'g') NOT IN (SELECT regexp_replace(text, '\\s+', '', 'g') FROM el WHERE kind = 'formula' AND text IS NOT NULL)",
    "page_renumber": f"WITH {EL}, {STUBBED} SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS new_page FROM (SELECT DISTINCT doc_id, page FROM el EXCEPT SELECT doc_id, page FROM stub)",
    "folio_strip": f"WITH {EL}, {GEO} SELECT doc_id, page, idx, {trim('text')} AS folio FROM el JOIN geo USING (doc_id, page) WHERE kind IN ('text', 'formula') AND regexp_full_match({trim('text')}, '[0-9]{{1,4}}') AND x1 - x0 <= 0.12 * width AND (y1 < 0.12 * height OR y0 > 0.9 * height)",
    "layout_gutter": f"WITH {EL2}, {GEO}, {SIDES} SELECT * FROM gut",
    "column_assign": f"WITH {EL2}, {GEO}, {SIDES} SELECT doc_id, page, idx, side FROM col",
    "column_right_edge": f"""WITH {EL2}, {GEO}, {SIDES}, c AS (SELECT *, CASE WHEN x0 < gutter AND gutter < margin THEN gutter - 8 ELSE margin END AS e FROM col)
SELECT doc_id, page, idx, round(CASE WHEN coalesce(width, 0) <= 0 THEN x0 + 200 WHEN e <= x0 + 20 THEN width - 24 ELSE e END, 2) AS column_right FROM c""",
    "vertical_coverage": f"WITH {EL}, {GEO}, {ISLANDS} SELECT doc_id, page, round(sum(greatest(0, least(b, height) - greatest(a, 0))) / max(height), 4) AS covered FROM isl JOIN geo USING (doc_id, page) WHERE height > 0 GROUP BY 1, 2",
    "uncovered_bands": f"""WITH {EL}, {GEO}, {ISLANDS}, r AS (SELECT * FROM isl JOIN geo USING (doc_id, page) WHERE height > 0), g AS (SELECT doc_id, page, greatest(0, coalesce(lag(b) OVER (PARTITION BY doc_id, page ORDER BY a), 0)) AS band_top, a AS band_bottom FROM r
UNION ALL SELECT doc_id, page, greatest(0, max(b)), max(height) FROM r GROUP BY 1, 2) SELECT * FROM g WHERE band_bottom - band_top >= 24""",
    "scan_image_marks": f"""WITH {EL}, {GEO}, {ISLANDS}, i AS (SELECT el.*, width, height FROM el JOIN geo USING (doc_id, page) WHERE kind = 'image' AND bbox IS NOT NULL AND (x1 - x0) * (y1 - y0) >= 0.8 * greatest(width * height, 1e-6))
SELECT i.doc_id, i.page, idx, coalesce(sum(greatest(0, least(b, y1) - greatest(a, y0)) / greatest(y1 - y0, 1e-6)), 0) >= 0.7 AS skipped FROM i LEFT JOIN isl ON isl.doc_id = i.doc_id AND isl.page = i.page GROUP BY 1, 2, 3""",
    "covered_spans": f"""WITH {EL}, {GEO}, b AS (SELECT el.*, width * height AS whole FROM el JOIN geo USING (doc_id, page) WHERE bbox IS NOT NULL), h AS (SELECT s.doc_id, s.page, s.idx, i.idx AS image_idx, (i.x1 - i.x0) * (i.y1 - i.y0) >= 0.8 * i.whole AS big
FROM b s JOIN b i ON s.doc_id = i.doc_id AND s.page = i.page AND i.kind = 'image' AND s.kind <> 'image' WHERE (s.x1 - s.x0) * (s.y1 - s.y0) > 0 AND greatest(0, least(s.x1, i.x1) - greatest(s.x0, i.x0)) * greatest(0, least(s.y1, i.y1) - greatest(s.y0, i.y0)) >= 0.6 * (s.x1 - s.x0) * (s.y1 - s.y0))
SELECT doc_id, page, idx, min(image_idx) AS image_idx, NOT arg_min(big, image_idx) AS dropped FROM h GROUP BY 1, 2, 3""",
    "line_estimate": f"WITH {EL} SELECT doc_id, page, idx, round({advance('text', 'coalesce(size, 11.0)')}, 2) AS advance, CAST({lines('text', 'coalesce(size, 11.0)', 'x1 - x0')} AS INTEGER) AS lines FROM el WHERE kind = 'text' AND text IS NOT NULL AND bbox IS NOT NULL",
    "height_estimate": f"""WITH {EL}, {TR}, e AS (SELECT el.doc_id, el.page, el.idx, coalesce(nullif(size, 0), 11.0) AS sz, greatest(x1 - x0, 4.0) AS w, CASE WHEN len(sentences) > 0 THEN sentences ELSE [coalesce(text, '')] END AS us, segs FROM el LEFT JOIN tr USING (doc_id, page, idx) WHERE kind = 'text' AND bbox IS NOT NULL),
u AS (SELECT *, coalesce(us[i], '') AS s, coalesce(segs[i], '') AS z FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM e)), v AS (SELECT *, {lines('s', 'sz', 'w')} AS a, CASE WHEN z <> '' THEN {lines('z', 'sz * 0.94', 'w - 16')} ELSE 0 END AS b FROM u)
SELECT doc_id, page, idx, CAST(sum(a + b) AS BIGINT) AS lines, round(sum(a * sz * 1.18 + CASE WHEN b > 0 THEN b * sz * 0.94 * 1.62 + 4.5 ELSE 0 END) * 1.02 + 1.0, 2) AS est_height FROM v GROUP BY 1, 2, 3""",
    "box_overlap": f"WITH {EL} SELECT a.doc_id, a.page, a.idx AS idx_a, b.idx AS idx_b FROM el a JOIN el b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx < b.idx WHERE a.kind <> 'image' AND b.kind <> 'image' AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 2 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 2",
    "coincident_slots": f"WITH {EL} SELECT doc_id, page, round_even(x0, 0) AS x, round_even(y0, 0) AS y, count(*) AS n FROM el WHERE bbox IS NOT NULL AND kind IN ('text', 'formula') AND NOT {BLANK} GROUP BY 1, 2, 3, 4 HAVING count(*) > 1",
    "containment_dups": f"""WITH {EL}, b AS (SELECT * FROM el WHERE bbox IS NOT NULL AND kind IN ('text', 'formula')) SELECT i.doc_id, i.page, i.idx, min(h.idx) AS host FROM b i JOIN b h ON i.doc_id = h.doc_id AND i.page = h.page AND i.idx <> h.idx WHERE i.kind = 'formula'
AND i.x0 >= h.x0 - 1 AND i.y0 >= h.y0 - 1 AND i.x1 <= h.x1 + 1 AND i.y1 <= h.y1 + 1 AND (i.x1 - i.x0) * (i.y1 - i.y0) < 0.5 * (h.x1 - h.x0) * (h.y1 - h.y0) GROUP BY 1, 2, 3""",
    "line_reflow": f"""WITH {EL}, e AS (SELECT doc_id, page, idx, x0, round_even(y0, 1) AS r, {trim('text')} AS t FROM el WHERE kind = 'text' AND bbox IS NOT NULL AND coalesce({trim('text')}, '') <> ''), l AS (SELECT *, lag(t) OVER w AS b, row_number() OVER w AS o FROM e WINDOW w AS (PARTITION BY doc_id, page ORDER BY r, x0, idx)),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR regexp_matches(b, '[.!?:;]$') OR regexp_matches(t, '^(\\(?[a-z0-9]{{1,3}}[.)]\\s|[•–-]\\s)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY o ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT doc_id, page, block, regexp_replace(string_agg(t, ' ' ORDER BY o), '([a-z])- ([a-z])', '\\1\\2', 'g') AS text, count(*) AS n FROM s GROUP BY 1, 2, 3""",
    "translation_newest": f"WITH {TR} SELECT doc_id, page, idx, CASE WHEN segs IS NULL THEN '-' ELSE array_to_string(list_transform(segs, lambda z: coalesce(z, '~')), '|') END AS segs FROM tr",
    "align_segments": f"""WITH {EL}, {TR}, {WANT}, a AS (SELECT want.*, {NONBLANK} AS zh, array_to_string({NONBLANK}, '') AS j FROM want JOIN tr USING (doc_id, page, idx)), b AS (SELECT *, len(zh) AS n, CASE WHEN j = '' THEN [] ELSE {zh_pieces('j')} END AS ps, greatest(1, len(zh) // greatest(want, 1)) AS per FROM a)
SELECT doc_id, page, idx, want, array_to_string(CASE WHEN n = 0 THEN list_transform(range(want), lambda i: '') WHEN n = want THEN zh WHEN n > want AND len(ps) = want THEN ps WHEN n > want AND want = 1 THEN [j]
WHEN n > want THEN list_transform(range(want), lambda i: array_to_string(list_slice(zh, i * per + 1, CASE WHEN i < want - 1 THEN i * per + per ELSE n END), '')) ELSE list_slice(list_concat(ps, list_transform(range(greatest(want - len(ps), 0)), lambda i: '')), 1, want) END, '|') AS segs,
CASE WHEN n = 0 THEN 'empty' WHEN n = want THEN '' WHEN n > want AND len(ps) = want THEN 'resplit' WHEN n > want THEN 'merged' WHEN len(ps) < want THEN 'split+padded' ELSE 'split' END AS note FROM b""",
    "zh_reconcile": f"""WITH {EL}, {TR}, {WANT}, a AS (SELECT want.*, list_transform(coalesce(segs, []), lambda z: {trim("regexp_replace(coalesce(z, ''), '^[[:space:]]*第[[:space:]]*[IVX]+[[:space:]]*卷[[:space:]]*[（(][^）)]*[）)][[:space:]]*', '')")}) AS zh FROM want JOIN tr USING (doc_id, page, idx)),
b AS (SELECT *, list_filter(zh, lambda z: z <> '') AS nb, CASE WHEN len(zh) = want THEN zh WHEN want = 1 THEN [array_to_string(list_filter(zh, lambda z: z <> ''), '')] ELSE list_transform(range(1, want + 1), lambda i: coalesce(zh[i], '')) END AS f FROM a)
SELECT doc_id, page, idx, want, CAST(len(zh) AS INTEGER) AS n_segs, array_to_string(f, '|') AS segs, CAST(len(list_filter(f, lambda z: {trim('z')} = '')) AS INTEGER) AS blanks FROM b""",
    "translation_audit": f"""WITH {EL}, {TR}, {WANT}, j AS (SELECT want.*, segs, tr.doc_id IS NOT NULL AS has FROM want LEFT JOIN tr ON tr.doc_id = want.doc_id AND tr.page = want.page AND tr.idx = want.idx WHERE want.doc_id IN ({SCOPE})),
e AS (SELECT doc_id, page, idx, i - 1 AS sent, coalesce({trim('segs[i]')}, '') AS z, coalesce({trim('sentences[i]')}, '') AS s FROM (SELECT *, unnest(range(1, want + 1)) AS i FROM j WHERE has AND len(segs) = want))
SELECT doc_id, page, idx, -1 AS sent, 'missing' AS problem FROM j WHERE NOT has AND NOT regexp_full_match(coalesce({trim('text')}, ''), '[0-9]{{1,3}}') UNION ALL SELECT doc_id, page, idx, -1, 'not an array' FROM j WHERE has AND segs IS NULL
UNION ALL SELECT doc_id, page, idx, -1, 'count' FROM j WHERE has AND len(segs) <> want UNION ALL SELECT doc_id, page, idx, CAST(sent AS INTEGER), 'blank' FROM e WHERE z = ''
UNION ALL SELECT doc_id, page, idx, CAST(sent AS INTEGER), 'placeholder' FROM e WHERE z <> '' AND regexp_matches(z, '{MARKS}') UNION ALL SELECT doc_id, page, idx, CAST(sent AS INTEGER), 'echo' FROM e WHERE z <> '' AND z = s AND regexp_matches(s, '[A-Za-z]{{3,}}')""",
    "bibliography_unify": f"WITH {EL}, {GEO} SELECT doc_id, page, idx, CAST(len(sentences) AS INTEGER) AS n_before FROM el JOIN geo USING (doc_id, page) WHERE kind = 'text' AND len(sentences) >= 2 AND bbox IS NOT NULL AND x1 - x0 >= 0.6 * width / 2",
    "content_realign": f"""WITH {EL}, o AS (SELECT doc_id, page, idx, regexp_replace(text, '[\\s\\x{{A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}]+', '', 'g') AS k FROM el WHERE text IS NOT NULL), nw AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) - 1 AS idx, text FROM el WHERE kind = 'text'),
n AS (SELECT doc_id, page, idx, regexp_replace(text, '[\\s\\x{{A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}]+', '', 'g') AS k FROM nw WHERE text IS NOT NULL)
SELECT a.doc_id, a.page, old_idx, CAST(new_idx AS INTEGER) AS new_idx FROM (SELECT doc_id, page, k, min(idx) AS old_idx FROM o GROUP BY 1, 2, 3 HAVING count(*) = 1 AND k <> '') a JOIN (SELECT doc_id, page, k, min(idx) AS new_idx FROM n GROUP BY 1, 2, 3 HAVING count(*) = 1 AND k <> '') b USING (doc_id, page, k)""",
    "stage_stats": f"WITH {EL} SELECT doc_id, count(*) FILTER (kind = 'text') AS texts, count(*) FILTER (kind = 'formula') AS formulas, count(*) FILTER (kind = 'image') AS images, CAST(sum(CASE WHEN kind = 'text' THEN coalesce(len(sentences), 0) ELSE 0 END) AS BIGINT) AS sentences, coalesce(array_to_string(list_sort(list_distinct(list(font))), ','), '') AS fonts FROM el GROUP BY 1",
    "folios_blanked": f"""WITH {EL}, {GEO}, {TR}, f AS (SELECT doc_id, page, idx FROM el JOIN geo USING (doc_id, page) WHERE bbox IS NOT NULL AND kind IN ('text', 'formula') AND regexp_full_match({trim('text')}, '[0-9]{{1,4}}') AND x1 - x0 <= 0.12 * width AND (y1 < 0.12 * height OR y0 > 0.9 * height)),
a AS (SELECT doc_id, page, count(*) AS texts FROM el ANTI JOIN f USING (doc_id, page, idx) WHERE text <> '' GROUP BY 1, 2), b AS (SELECT doc_id, page, count(*) AS translated FROM tr ANTI JOIN f USING (doc_id, page, idx) GROUP BY 1, 2) SELECT doc_id, page, texts, translated FROM a FULL JOIN b USING (doc_id, page)""",
    "references_unified": f"""WITH {EL}, {GEO}, l AS (SELECT doc_id, max(page) AS page FROM pages_geo GROUP BY 1)
SELECT doc_id, page, idx, {trim('text')} AS text FROM el JOIN geo USING (doc_id, page) JOIN l USING (doc_id, page) WHERE kind = 'text' AND bbox IS NOT NULL AND len(sentences) >= 2 AND x1 - x0 >= 0.6 * width / 2 AND coalesce({trim('text')}, '') <> ''""",
    "delivery_volumes": "SELECT date_trunc('day', ingested_at)::TIMESTAMP AS day, kind, count(*) AS n, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS characters FROM elements WHERE ingested_at IS NOT NULL GROUP BY 1, 2",
}
