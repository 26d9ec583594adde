"""SQL for DuckDB of those queries that SQL can express."""

from __future__ import annotations

from . import chat, quality, secrets

_WORD = r"[^\x20\x09-\x0D]+"
_PLACED = """placed AS (SELECT d, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words)"""


def _count(characters: str) -> str:
    return f"length(regexp_replace(t, '[^{characters}]', '', 'g'))"


_FAILED = " + ".join(f"CASE WHEN {condition} THEN {quality.BIT[name]} ELSE 0 END" for name, condition in quality.RULES)

QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT d, regexp_extract_all(t, '{_WORD}') AS w FROM docs),
{_PLACED},
grams AS (SELECT d, i, word || chr(10) || lead(word) OVER o || chr(10) || lead(word, 2) OVER o AS g FROM placed WINDOW o AS (PARTITION BY d ORDER BY i)),
twice AS (SELECT d, i FROM (SELECT d, i, count(*) OVER (PARTITION BY d, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT d, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) r(k) GROUP BY d),
lines AS (SELECT d, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT d, unnest(string_split(t, chr(10))) AS line FROM docs)
 WHERE regexp_matches(line, '{_WORD}') GROUP BY d),
measured AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_count('#*$%&|<>')} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, {_count('A-Z')} AS n_upper, {_count('a-z')} AS n_lower, {_count('!')} AS n_exclaim
 FROM docs JOIN words USING (d) LEFT JOIN lines USING (d) LEFT JOIN covered USING (d)),
ledger AS (SELECT *, ({_FAILED})::BIGINT AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality.mask('base-1')} <> 0 AS base_failed,
 failed & {quality.mask(quality.DEFAULT_POLICY)} = 0 AS kept, failed FROM ledger"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (SELECT doc_id AS d, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
{_PLACED},
ahead AS (SELECT d, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM placed WINDOW o AS (PARTITION BY d ORDER BY i)),
shingles AS (SELECT DISTINCT d, g FROM ahead WHERE g IS NOT NULL UNION SELECT d, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT d, count(*) AS n FROM shingles GROUP BY d),
common AS (SELECT a.d AS a, b.d AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.d < b.d GROUP BY a.d, b.d),
links AS (SELECT a, b FROM common JOIN sizes x ON x.d = a JOIN sizes y ON y.d = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN sizes ON d = doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id"""

_BEFORE, _BETWEEN, _AFTER = (x.replace("\n", "' || chr(10) || '") for x in chat.TEMPLATE)

CHAT = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
rendered AS (SELECT conv_id, row_number() OVER o AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
 string_agg('{_BEFORE}' || role || '{_BETWEEN}' || text || '{_AFTER}', '') OVER o AS prefix FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT prefix, min(conv_id) AS conv_id, min(n_turns) AS n_turns, count(*) AS n_copies FROM rendered WHERE place = n_turns GROUP BY prefix)
SELECT conv_id, n_turns, n_copies, prefix AS text FROM whole WHERE prefix NOT IN (SELECT prefix FROM rendered WHERE place < n_turns)"""

_ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token"))
_ASSIGN += "|[aA][pP][iI]_?[kK][eE][yY])" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: int, pattern: str, keep: str = "true") -> str:
    return f"""SELECT d, {kind} AS kind, before - length(m) AS start, before AS "end", m FROM (SELECT d, m,
 sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY d ORDER BY i)::BIGINT AS before FROM (SELECT d, unnest(string_split_regex(t, '{pattern}')) AS p,
 unnest(list_append(regexp_extract_all(t, '{pattern}'), NULL)) AS m, unnest(range(len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM docs
 WHERE regexp_matches(t, '{pattern}'))) WHERE m IS NOT NULL AND {keep}"""


def _tail(z: str) -> str:
    return f"CASE WHEN {z} <= 0 THEN 1.0 ELSE exp(-({z}) * ({z}) / 2) END"


_KIND = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'random' END || ':' || start || ':' || \"end\""

SECRETS = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_found(0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")} UNION ALL {_found(1, secrets.ACCESS)} UNION ALL {_found(2, secrets.HEX)}),
candidates AS (SELECT row_number() OVER () AS k, * FROM ({_found(3, secrets.CANDIDATE)}) c
 WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.d = c.d AND b.start <= c.start AND c."end" <= b."end")),
chars AS (SELECT k, ord(unnest(string_split(m, ''))) AS x, unnest(range(length(m))) AS i FROM candidates),
squares AS (SELECT k, sum(n * n)::DOUBLE AS sq FROM (SELECT k, x, count(*) AS n FROM chars GROUP BY k, x) GROUP BY k),
centred AS (SELECT k, i, x - avg(x) OVER (PARTITION BY k) AS x FROM chars),
lagged AS (SELECT k, x, x * lead(x) OVER (PARTITION BY k ORDER BY i) AS xy FROM centred),
series AS (SELECT k, sum(x * x) AS var, sum(xy) AS cov FROM lagged GROUP BY k),
shaped AS (SELECT c.*, length(m)::DOUBLE AS n, sq, var, cov, (len(regexp_extract_all(m, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+')) - 1)::DOUBLE AS changes,
 CASE WHEN regexp_matches(m, '^[0-9]+$') THEN 10.0::DOUBLE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN 16.0::DOUBLE WHEN regexp_matches(m, '^[A-Z2-7]+=*$') THEN 32.0::DOUBLE
  WHEN regexp_matches(m, '^([0-9a-z]+|[0-9A-Z]+)$') THEN 36.0::DOUBLE ELSE 64.0::DOUBLE END AS size FROM candidates c JOIN squares USING (k) JOIN series USING (k)),
scaled AS (SELECT *, CASE size WHEN 10 THEN 0.0 WHEN 16 THEN 120 / 256.0 WHEN 32 THEN 312 / 1024.0 WHEN 36 THEN 520 / 1296.0 ELSE 1 - 1456 / 4096.0 END::DOUBLE AS differ, changes / (n - 1) AS rate FROM shaped),
tested AS (SELECT *, (size / n * sq - n - (size - 1)) / sqrt(2 * (size - 1)) AS uniform,
 CASE WHEN differ > 0 THEN ((n - 1) * differ - changes) / sqrt((n - 1) * differ * (1 - differ)) ELSE 0 END AS too_few, CASE WHEN var > 0 THEN (cov / var * n + 1) / sqrt(n) ELSE 99 END AS serial FROM scaled),
judged AS (SELECT *, CASE WHEN 3 * least({_tail("uniform")}, {_tail("too_few")}, {_tail("abs(serial)")}) >= {secrets.LEVEL} THEN
 exp(-(n - 1) * CASE WHEN rate <= {secrets.ORDINARY} THEN 0 ELSE rate * ln(rate / {secrets.ORDINARY}) + CASE WHEN rate < 1 THEN (1 - rate) * ln((1 - rate) / {1 - secrets.ORDINARY}) ELSE 0 END END)
 ELSE 1.0 END AS p0 FROM tested),
weighed AS (SELECT *, p0 * sum(n) OVER (PARTITION BY d) / (n * count(*) OVER (PARTITION BY d)) AS p, count(*) OVER (PARTITION BY d) AS m_all FROM judged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY p) AS r FROM weighed),
limits AS (SELECT d, max(p) AS most FROM ranked WHERE p * m_all <= {secrets.FDR} * r GROUP BY d),
spans AS (SELECT d, kind, start, "end" FROM base UNION ALL SELECT d, kind, start, "end" FROM ranked JOIN limits USING (d) WHERE p <= most),
listed AS (SELECT d, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
 string_agg({_KIND}, ',' ORDER BY start, kind, "end") FILTER (WHERE kind < 3) AS base, string_agg({_KIND}, ',' ORDER BY start, kind, "end") AS spans FROM spans GROUP BY d)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (d)"""

#: The checksum of a text, byte by byte: DuckDB has no function for it.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k::INTEGER + 1, 2))::BIGINT)),
 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""

_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]{{7,}}')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM found GROUP BY doc_id, w),
hashed AS (SELECT w, c, {_CRC} AS h FROM counted, crc_table),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(length(word)))::INTEGER AS k FROM words),
wild AS (SELECT word, n, left(word, k) || '*' || substr(word, k + 2) AS g FROM places),
less AS (SELECT DISTINCT word, n, left(word, k) || substr(word, k + 2) AS g FROM places),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.g = b.g AND a.word <> b.word
 UNION ALL SELECT l.word, l.n, s.word, s.n FROM less l JOIN words s ON l.g = s.word UNION ALL SELECT s.word, s.n, l.word, l.n FROM less l JOIN words s ON l.g = s.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS m, first(n) AS n FROM pairs GROUP BY word),
forms AS (SELECT word, best AS form, m AS form_n FROM near WHERE m >= 10 * n),
chain AS (SELECT word, form AS reached, 1 AS step FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.reached),
roots AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(x.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN near x USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)"""

_ENTITIES = [("&quot;", '"'), ("&apos;", "\'\'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&amp", "&")]


def _decoded(x: str) -> str:
    for name, char in _ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return x


#: What a page's article holds, as far as the driver's pages have markup: headings, paragraphs, breaks, bold words, a few character references.
HTML = rf"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS x FROM pages),
blocks AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:h[1-6]|p)(?:\s[^>]*)?>'),
 lambda b: trim(regexp_replace({_decoded("regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g'))) AS bs FROM articles),
texts AS (SELECT page_id, url, array_to_string(list_filter(bs, lambda b: b <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts"""

#: Runs by all pairs of equal words of a text that stand a period apart: stretches of such pairs, without those that a smaller period has.
RUNS = rf"""
WITH {_CRC_TABLE},
given AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, hex(encode(doc_id::VARCHAR)) AS x FROM documents),
keyed AS (SELECT d, doc_id, w, len(w) AS n, CASE WHEN x IS NULL THEN 1 ELSE {_CRC} END AS h FROM given, crc_table),
ruled AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM keyed),
docs AS (SELECT d, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE w END AS w FROM ruled),
placed AS (SELECT d, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
often AS (SELECT d, word, n FROM (SELECT d, word FROM placed GROUP BY d, word HAVING count(*) >= 4) JOIN docs USING (d)),
pairs AS (SELECT x.d, x.i, y.i - x.i AS q FROM often o JOIN placed x ON x.d = o.d AND x.word = o.word JOIN placed y ON y.d = o.d AND y.word = o.word AND y.i > x.i WHERE y.i - x.i <= o.n // 4),
stretches AS (SELECT d, q, min(i) AS s, count(*) + q AS l FROM (SELECT d, q, i, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS k FROM pairs) GROUP BY d, q, k),
long AS (SELECT * FROM stretches WHERE l >= greatest(6, 4 * q)),
runs AS (SELECT d, s, l, q FROM long r WHERE NOT EXISTS (SELECT 1 FROM stretches b WHERE b.d = r.d AND b.q < r.q AND b.s <= r.s AND b.s + b.l >= r.s + r.l)),
best AS (SELECT d, s, l, q FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY l / q DESC, s, q) AS k FROM runs) WHERE k = 1),
told AS (SELECT d, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY d),
dropped AS (SELECT DISTINCT d, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT d, string_agg(word, ' ' ORDER BY i) AS rest FROM placed ANTI JOIN dropped USING (d, i) GROUP BY d)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (d) LEFT JOIN best USING (d) LEFT JOIN kept USING (d)"""
