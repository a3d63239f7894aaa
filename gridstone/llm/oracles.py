"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from gridstone.llm.quality import DISTRUST, MAX_HOST_RATE, REPEAT_SHARE
from gridstone.llm.url_filter import JUNK_SYMBOLS, LOWER, SYMBOL_SHARE, TRACKING, UPPER

BLANK = r"[\x20\x09-\x0D]"


def op4(rules: list[tuple[str, str, str]]) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
WITH p AS (SELECT page_id, url, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS params FROM p),
c AS (SELECT *, CASE WHEN position('://' IN url) > 0 THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html)?/*$', '')
  || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS own FROM q),
listed AS (SELECT DISTINCT own FROM c WHERE {SYMBOL_SHARE} * (length(html) - length(translate(html, '{JUNK_SYMBOLS}', ''))) > length(html)),
rules(h, s, v) AS (VALUES {listed}),
fit AS (SELECT page_id, url, arg_max(h || s, length(h || s) * 4096 + length(h)) AS rule, arg_max(v, length(h || s) * 4096 + length(h)) AS v
  FROM (SELECT DISTINCT page_id, url, host, path FROM c) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, fit.rule, coalesce(fit.v, CASE WHEN c.own IN (SELECT own FROM listed WHERE own IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON c.page_id IS NOT DISTINCT FROM fit.page_id AND c.url IS NOT DISTINCT FROM fit.url"""


OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{BLANK}+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{BLANK}+', '', 'g') <> '') AS lines FROM d),
k AS (SELECT r, unnest(range(1, len(words) - 1)) AS pos, words FROM w),
g AS (SELECT r, pos, count(*) OVER (PARTITION BY r, words[pos], words[pos + 1], words[pos + 2]) AS c FROM k),
r AS (SELECT r, count(DISTINCT pos + o) AS n FROM g, range(3) u(o) WHERE c > 1 GROUP BY r),
f AS (SELECT w.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{BLANK}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON r.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines FROM f),
s AS (SELECT source, count(*) AS n, unnest([count(*) FILTER (base_failed), count(*) FILTER (symbols), count(*) FILTER (lines)]) AS bad, unnest(['base', 'symbols', 'lines']) AS rule FROM b GROUP BY source),
m AS (SELECT rule, sum(n::DOUBLE) AS n, count(*) AS hosts, sum(n::DOUBLE * n) AS squares, sum(bad::DOUBLE) AS bad, sum(bad::DOUBLE * bad / n) AS bads FROM s GROUP BY rule),
v AS (SELECT rule, bad / n AS m, CASE WHEN n > hosts AND hosts > 1 THEN ((bads - bad * (bad / n)) / (hosts - 1) - (bad - bads) / (n - hosts)) * (hosts - 1) / (n - squares / n) ELSE 0e0 END AS v FROM m),
p AS (SELECT rule, m, least(greatest(m * (1 - m) / greatest(v, 1e-9) - 1, 1e0), 1000e0) AS weight FROM v),
j AS (SELECT source, rule, m, (bad + m * weight) / (n + weight) AS rate FROM s JOIN p USING (rule)),
h AS (SELECT source, max(m) FILTER (rule = 'base') AS m, max(rate) FILTER (rule = 'base') AS rate, max(rate) FILTER (rule = 'symbols') AS symbols, max(rate) FILTER (rule = 'lines') AS lines FROM j GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND h.rate <= {MAX_HOST_RATE}
  AND n_repeat_words <= (CASE WHEN h.rate > m AND m < 1 THEN {REPEAT_SHARE} * (1 - h.rate) / (1 - m) ELSE {REPEAT_SHARE} END) * n_words
  AND NOT (b.symbols AND h.symbols > {DISTRUST}) AND NOT (b.lines AND h.lines > {DISTRUST}) AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM benchmark),
iw AS (SELECT item_id, least(13, len(words)) AS m, words, unnest(range(1, greatest(2, len(words) - 11))) AS pos FROM i WHERE len(words) > 0),
win AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, m, array_to_string(words[pos:pos + m - 1], ' ') AS w FROM iw),
sizes AS (SELECT DISTINCT m FROM win),
dk AS (SELECT r, words, m, unnest(range(1, len(words) - m + 2)) AS pos FROM d, sizes WHERE len(words) >= m),
hit AS (SELECT r, pos, dk.m, item FROM dk JOIN win ON win.m = dk.m AND win.w = array_to_string(words[pos:pos + dk.m - 1], ' ')),
n AS (SELECT r, count(DISTINCT pos + o) AS n_hit FROM (SELECT DISTINCT r, pos, m FROM hit), range(13) u(o) WHERE o < m GROUP BY r),
ids AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN ids ON ids.r = d.r"""


OP12 = r"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM documents),
e AS (SELECT *, concat(%s) AS head, concat(%s) AS tail FROM d),
c AS (SELECT *, concat(%s) AS same, concat(%s) AS more, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS crc FROM e),
l AS (SELECT doc_id, lang, idx, n, sha256(head || same || tail) AS leaf, CASE WHEN xor(crc, 4294967295) %% 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || same || tail) END AS moved FROM c),
t AS (SELECT 0 AS k, coalesce('=' || lang, '') AS g, idx, n, leaf AS node FROM l UNION ALL
  SELECT k + 1, g, idx // 2, (n + 1) // 2, sha256(node || coalesce(other, '')) FROM (SELECT *, lead(node) OVER (PARTITION BY g ORDER BY idx) AS other FROM t) WHERE n > 1 AND idx %% 2 = 0),
s AS (SELECT g, node FROM t WHERE n = 1),
u AS (SELECT 0 AS k, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, node FROM s UNION ALL
  SELECT k + 1, idx // 2, (n + 1) // 2, sha256(node || coalesce(other, '')) FROM (SELECT *, lead(node) OVER (ORDER BY idx) AS other FROM u) WHERE n > 1 AND idx %% 2 = 0),
gs AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS idx FROM s),
low AS (SELECT l.doc_id, l.idx AS leaf_idx, a.g, a.k, (l.idx >> a.k) %% 2 AS slot, b.node AS sib FROM l JOIN t a ON a.g = coalesce('=' || l.lang, '') AND a.idx = l.idx >> a.k AND a.n > 1
  LEFT JOIN t b ON b.g = a.g AND b.k = a.k AND b.idx = xor(a.idx, 1)),
high AS (SELECT gs.g, 1000 + a.k AS k, (gs.idx >> a.k) %% 2 AS slot, b.node AS sib FROM gs JOIN u a ON a.idx = gs.idx >> a.k AND a.n > 1 LEFT JOIN u b ON b.k = a.k AND b.idx = xor(a.idx, 1)),
steps AS (SELECT doc_id, leaf_idx, g, k, slot, sib FROM low UNION ALL SELECT l.doc_id, l.idx, high.g, k, slot, sib FROM l JOIN high ON high.g = coalesce('=' || l.lang, '')),
paths AS (SELECT g, leaf_idx, list({'slot': slot, 'sib': sib} ORDER BY k) AS path FROM steps GROUP BY ALL),
f AS (SELECT l.*, coalesce('=' || lang, '') AS g, coalesce(path, []) AS path FROM l LEFT JOIN paths ON paths.g = coalesce('=' || lang, '') AND leaf_idx = l.idx),
w AS (SELECT g, idx, 1 AS pos, moved AS v, path FROM f UNION ALL
  SELECT g, idx, pos + 1, sha256(CASE WHEN path[pos].slot = 1 THEN path[pos].sib || v ELSE v || coalesce(path[pos].sib, '') END), path FROM w WHERE pos <= len(path)),
top AS (SELECT node AS root FROM u WHERE n = 1)
SELECT f.doc_id, f.leaf, s.node AS subroot, root, sha256(coalesce(array_to_string(list_filter(list_transform(f.path, lambda x: x.sib), lambda x: x IS NOT NULL), ''), '')) AS proof_sha256, w.v AS folded_root, w.v = root AS verified
FROM f JOIN s ON s.g = f.g JOIN w ON w.g = f.g AND w.idx = f.idx AND w.pos = len(f.path) + 1, top""" % tuple(
    ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in part) for part in (("doc_id", "source", "lang"), ("text",), ("n_chars",), ("n_chars + 1",))
)


OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT r, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS nr FROM d),
q AS (SELECT r, lang, nr, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
k AS (SELECT r, lang, nr, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM q),
x AS (SELECT lang, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM k WINDOW o AS (PARTITION BY r, nr ORDER BY i)),
one AS (SELECT lang, a AS w, count(*) AS f FROM x GROUP BY ALL),
two AS (SELECT lang, a, b, a || ' ' || b AS w, count(*) AS f FROM x WHERE b IS NOT NULL GROUP BY ALL HAVING f >= 10),
three AS (SELECT lang, a, b, c, a || ' ' || b || ' ' || c AS w, a || ' ' || b AS ab, b || ' ' || c AS bc, count(*) AS f FROM x WHERE c IS NOT NULL GROUP BY ALL HAVING f >= 10),
part AS (SELECT lang, w, f FROM one WHERE f >= 10 UNION ALL SELECT lang, w, f FROM two),
cut AS (SELECT lang, w, f, 1 AS k, a AS first, b AS rest FROM two UNION ALL SELECT lang, w, f, 1, a, bc FROM three UNION ALL SELECT lang, w, f, 2, ab, c FROM three),
s AS (SELECT cut.lang, cut.w, cut.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * cut.f * cut.f) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN part l ON l.lang = cut.lang AND l.w = first JOIN part r ON r.lang = cut.lang AND r.w = rest),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS nth FROM s),
around AS (SELECT lang, w, max(f) AS longer FROM (SELECT lang, ab AS w, f FROM three UNION ALL SELECT lang, bc, f FROM three) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN around o ON o.lang = best.lang AND o.w = best.w WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, w) AS rank FROM kept),
n AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang)
SELECT ranked.lang, rank, w AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""
