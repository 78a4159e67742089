"""DuckDB twins of the corpus queries whose whole result SQL can say."""
from __future__ import annotations

from tidemark.llm.common import LOWER, UPPER
from tidemark.llm.licenses import BLOCK, PHRASES, REACH, TEMPLATES, telling

_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, len(g) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, list_slice(w, i, i + 12) AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(gram) AS n FROM g),
x AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, n, item FROM x JOIN g USING (gram)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE list_slice(w, i, i + {len(p.split()) - 1}) = {_list(p.split())}"
    for p, label in PHRASES.items())
_KNOWN = " UNION ALL ".join(
    f"SELECT {i} AS template, '{label}' AS label, {_list(sorted(set(t.split())))} AS ts, {REACH * len(t.split())} AS reach, CAST({_list(telling(t)[0])} AS VARCHAR[]) AS must, CAST({_list(telling(t)[1])} AS VARCHAR[]) AS never"
    for i, (label, t) in enumerate(TEMPLATES))
LICENSES = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS ({_PLACES}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS own FROM p GROUP BY doc_id),
lines AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)),
k AS (SELECT doc_id, w FROM lines WHERE len(w) BETWEEN 1 AND {BLOCK} UNION ALL
      SELECT doc_id, list_slice(w, i + 1, i + {BLOCK}) FROM (SELECT doc_id, w, unnest(range(0, len(w) - {BLOCK // 2} + 1, {BLOCK // 2})) AS i FROM lines WHERE len(w) > {BLOCK})),
known AS ({_KNOWN}),
m AS (SELECT doc_id, label, len(list_intersect(ts, w)) / len(ts) AS share FROM k, known WHERE list_has_any(ts, w) AND list_has_all(w, must) AND NOT list_has_any(w, never)),
c AS (SELECT doc_id, template, label, ts, reach, must, never, w FROM d, known WHERE len(list_intersect(ts, w)) >= 0.8 * len(ts) - 1e-9),
q AS (SELECT doc_id, template, i - 1 AS at, w[i] AS token FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c) WHERE list_contains(ts, w[i]) OR list_contains(must, w[i]) OR list_contains(never, w[i])),
st AS (SELECT x.doc_id, x.template, x.at, list(DISTINCT y.token) AS inside FROM q x JOIN known USING (template) JOIN q y ON y.doc_id = x.doc_id AND y.template = x.template AND y.at >= x.at AND y.at < x.at + reach WHERE list_contains(ts, x.token) GROUP BY 1, 2, 3),
s AS (SELECT doc_id, label, len(list_intersect(ts, inside)) / len(ts) AS share FROM st JOIN known USING (template) WHERE list_has_all(inside, must) AND NOT list_has_any(inside, never)),
more AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS best FROM (SELECT * FROM m UNION ALL SELECT * FROM s) WHERE share >= 0.8 - 1e-9 GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(own, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(found, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


# crc32 of a string of ASCII characters, spelt with the table of its polynomial (given `crc_table.t`)
_CRC_TABLE = """
steps(i, v, k) AS (SELECT i, i, 0 FROM range(256) n(i) UNION ALL SELECT i, xor(v >> 1, 3988292384 * (v & 1)), k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8)"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(unicode(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


PREFIX_TRIE = rf"""
WITH RECURSIVE {_CRC_TABLE},
own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, l, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, crc_table),
full_ AS (SELECT o.conv_id AS c, list_concat(list_slice(coalesce(b.l, []), 1, h), list_slice(o.l, h + 1, len(o.l))) AS l
          FROM h o LEFT JOIN own b ON b.conv_id = o.conv_id - (o.conv_id % 5 + 5) % 5),
p AS (SELECT c, d, len(l) AS n, sha256(CAST(list_slice(l, 1, d) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(list_slice(l, 1, d - 1) AS VARCHAR)) END AS up, CASE WHEN d > 0 THEN strlen(l[d].t) ELSE 0 END AS bytes
      FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM full_)),
v AS (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM p GROUP BY d, k),
kids AS (SELECT up, d - 1 AS d, count(*) AS kids FROM v WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT v.*, coalesce(kids, 0) AS kids FROM v LEFT JOIN kids ON kids.up = v.k AND kids.d = v.d),
sums AS (SELECT p.k, p.d, sum((w.n - 1) * w.bytes) AS saved, count(*) FILTER (w.kids = 0) AS leaves FROM w JOIN p ON p.c = w.c AND p.d <= w.d GROUP BY 1, 2)
SELECT w.c AS conv_id, w.d AS depth, u.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN sums ON sums.k = w.k AND sums.d = w.d LEFT JOIN v u ON u.k = w.up AND u.d = w.d - 1"""

# a parse walks the rows and keeps the least (cost, audit) per state: 0 start, 1 after s, 2 after u, 3 after a
TURN_REPAIR = rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE code <> 0)),
n AS (SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair,
             right(regexp_replace(text, '[ 	-
]+$', ''), 1) AS last FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, last = '' AS blank, last <> '' AND again > 1 AS dup, last <> '' AND again = 1 AND last NOT IN ('.', '!', '?') AS cut
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM n)),
step(p, q, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
edit AS (SELECT conv_id, i, p, p AS q, 3 AS c, 'D' AS a FROM f, range(4) s(p) UNION ALL
         SELECT conv_id, i, p, q, CAST(cut AS INT), 'K' FROM f JOIN step ON initial = role[1] WHERE NOT blank AND NOT dup UNION ALL
         SELECT conv_id, i, p, q, 2 + CAST(cut AS INT), 'R' FROM f, step WHERE initial <> 's' AND NOT blank AND NOT dup),
move AS (SELECT conv_id, i, edit.p, ins.q, min({{'c': edit.c + ins.c, 'a': edit.a || ins.a}}) AS m FROM edit JOIN ins ON ins.p = edit.q GROUP BY ALL),
walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, q, {{'c': ins.c, 'a': ins.a}} AS m FROM f, ins WHERE ins.p = 0 UNION ALL
         SELECT w.conv_id, w.i + 1, t.q, min({{'c': w.m.c + t.m.c, 'a': w.m.a || t.m.a}}) FROM walk w JOIN move t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 AND t.p = w.q GROUP BY w.conv_id, w.i + 1, t.q),
total AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
best AS (SELECT total.conv_id, min(m) AS m FROM total JOIN walk w ON w.conv_id IS NOT DISTINCT FROM total.conv_id AND w.i = total.n AND w.q IN (0, 3) GROUP BY total.conv_id),
marks AS (SELECT conv_id, k, a[k] AS e, len(replace(left(a, k - 1), 'I', '')) + 1 AS i, len(replace(left(a, k), 'D', '')) AS place FROM (SELECT conv_id, m.a AS a, unnest(range(1, len(m.a) + 1)) AS k FROM best)),
turns AS (SELECT marks.conv_id, k, e, place, role, text, max(CASE WHEN place = 1 AND e = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY marks.conv_id) AS opened
          FROM marks LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM marks.conv_id AND f.i = marks.i WHERE e <> 'D'),
done AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS r FROM turns GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(m.c, 0) AS BIGINT) AS cost, coalesce(m.a, '') AS audit, sha256(coalesce(r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN total ON total.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id"""
