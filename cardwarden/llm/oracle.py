"""Expected results as SQL, where SQL can express them."""

from __future__ import annotations

_URLS = r"""
 SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(tail, '^[^?#]*\?([^#]*)', 1) AS query
 FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages)
"""
_RULED = f"""
 SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') ||
   CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END END AS canonical,
  CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
   WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
   WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
   WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
   WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
 FROM (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))) AS parts FROM ({_URLS}))
"""

ORACLE: dict[str, str] = {
    "op2_url_filter": f"""
WITH r AS ({_RULED}), listed AS (SELECT DISTINCT canonical FROM r WHERE page_id % 50 = 0 AND canonical IS NOT NULL)
SELECT page_id, host, path, rule,
 CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
    "op12_phrases": r"""
WITH p AS (
 SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
 FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, words[i:i + k - 1] AS ws, k FROM s, range(1, 6) AS t(k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, k, any_value(ws) AS ws, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
inside AS (
 SELECT DISTINCT a.lang, a.phrase FROM c a JOIN c b
  ON a.lang = b.lang AND b.k > a.k AND b.f >= a.f AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')
), cuts AS (
 SELECT c.lang, c.phrase, c.f AS a, j, array_to_string(c.ws[1:j], ' ') AS head, array_to_string(c.ws[j + 1:c.k], ' ') AS tail
 FROM c ANTI JOIN inside USING (lang, phrase), range(1, 5) AS r(j) WHERE j < c.k
), scored AS (
 SELECT cuts.lang, cuts.phrase, a, j, l.f AS l, r.f AS r, n,
  CAST(1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
 FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail
  JOIN t ON t.lang = cuts.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000""",
}
