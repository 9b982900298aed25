"""DuckDB SQL for the queries that SQL expresses: the contract read plainly, not the operators' methods."""

from __future__ import annotations

from .license_scan import K, NOTICES, PHRASES, SHARE, SLIP, template_rows
from .line_runs import LONG_WORDS, MIN_LINES, RUN_WORDS
from .url_reputation import LEVELS, LIMIT, SUFFIXES, Z

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(ASCII_LOWER.format("coalesce(text, '')"))
PLAIN_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')".format(ASCII_LOWER.format("coalesce(text, '')"))


def url_reputation(rules: list[tuple[str, str]], outcomes: str) -> str:
    """``outcomes``: SQL for rows (url, bad)."""
    host = ASCII_LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    levels = []
    for level, parent in zip(LEVELS, ("''", *LEVELS), strict=False):
        above = "top" if level == LEVELS[0] else f"p_{parent}"
        levels.append(f"""g_{level} AS (
  SELECT h.{level} AS key, any_value(t.a / (t.a + t.b)) AS m, sum(h.n) AS n, sum(h.x) AS x
  FROM hosts h JOIN {above} t ON t.key = {"''" if level == LEVELS[0] else "h." + parent} WHERE h.{level} <> '' GROUP BY 1),
s_{level} AS (
  SELECT 1 / least(greatest(coalesce(sum((x - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.01), 0.9) - 1 AS s
  FROM g_{level}),
p_{level} AS (SELECT key, s * m + x AS a, s * (1 - m) + n - x AS b FROM g_{level}, s_{level})""")
    found = " UNION ALL ".join(["SELECT 0 AS depth, key, a, b FROM top"] + [f"SELECT {i + 1}, key, a, b FROM p_{x}" for i, x in enumerate(LEVELS)])
    site = r"regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.+$', '')"
    tail = "array_to_string(list_reverse(list_reverse(string_split(site, '.'))[1:{}]), '.')"
    known = ", ".join(f"'{x}'" for x in SUFFIXES)  # all of two labels
    address = r"regexp_matches(site, '^([0-9]+(\.[0-9]+){3}$|\[)')"
    suffix = f"CASE WHEN {address} THEN site WHEN {tail.format(2)} IN ({known}) THEN {tail.format(2)} ELSE {tail.format(1)} END"
    domain = tail.format("1 + len(string_split(suffix, '.'))")
    return f"""
WITH outcomes AS ({outcomes}),
counted AS (SELECT host, count(*) AS n, sum(bad) AS x FROM (SELECT {host} AS host, bad FROM outcomes WHERE url IS NOT NULL AND bad IS NOT NULL) GROUP BY 1),
sites AS (SELECT {site} AS site, sum(n) AS n, sum(x) AS x FROM counted GROUP BY 1),
hosts AS (SELECT site AS host, {domain} AS domain, suffix, n::DOUBLE AS n, x::DOUBLE AS x FROM (SELECT *, {suffix} AS suffix FROM sites)),
top AS (SELECT '' AS key, coalesce(sum(x), 0) + 1.0 AS a, coalesce(sum(n), 0) - coalesce(sum(x), 0) + 1.0 AS b FROM hosts),
{", ".join(levels)},
found AS ({found}),
own AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (SELECT host, site, {domain} AS domain, suffix FROM (SELECT *, {suffix} AS suffix FROM (SELECT DISTINCT host, {site} AS site FROM own))),
best AS (
  SELECT n.host, arg_max(f.a, f.depth) AS a, arg_max(f.b, f.depth) AS b FROM named n JOIN found f
  ON f.depth = 0 OR f.depth = 1 AND f.key = n.suffix OR f.depth = 2 AND f.key = n.domain OR f.depth = 3 AND f.key = n.site GROUP BY 1),
judged AS (SELECT host, round(a / (a + b), 6) AS bad_mean, round(a / (a + b) - {Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))), 6) AS bad_bound FROM best),
rules(said, rule, name, start) AS (VALUES {values}),
ruled AS (
  SELECT o.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.said, length(r.rule)) AS said
  FROM own o JOIN rules r ON (o.host = r.name OR ends_with(o.host, '.' || r.name)) AND starts_with(o.path, r.start) GROUP BY 1)
SELECT o.page_id, o.host, o.path, r.rule, coalesce(r.said, CASE WHEN j.bad_bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, j.bad_mean, j.bad_bound
FROM own o JOIN judged j USING (host) LEFT JOIN ruled r USING (page_id)"""


LINE_RUNS = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, len(regexp_extract_all(s, '[^ \t\r\f\x0B]+')) AS words
  FROM lines WHERE trim(s, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
runs AS (
  SELECT doc_id, i, list(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {MIN_LINES - 1} FOLLOWING) AS w FROM seq),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM runs WHERE len(w) = {MIN_LINES}) WHERE n > 1),
pairs AS (
  SELECT doc_id, i, list(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS w,
    sum(words) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS words FROM seq),
wordy AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM pairs WHERE len(w) = 2 AND words >= {RUN_WORDS}) WHERE n > 1),
gone AS (
  SELECT s.doc_id, s.line FROM wordy l JOIN seq s ON s.doc_id = l.doc_id AND s.i BETWEEN l.i AND l.i + 1
  UNION SELECT s.doc_id, s.line FROM later l JOIN seq s ON s.doc_id = l.doc_id AND s.i BETWEEN l.i AND l.i + {MIN_LINES - 1}
  UNION SELECT doc_id, line FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM seq WHERE words >= {LONG_WORDS}) WHERE n > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_deleted,
  coalesce(string_agg(CASE WHEN g.line IS NULL THEN l.s END, chr(10) ORDER BY l.line), '') AS text
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id"""

EXACT_DEDUP = """
WITH texts AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, t.keep_id, t.group_size, d.doc_id = t.keep_id AS kept, sha256(t.t) AS text_sha256
FROM documents d JOIN texts t ON coalesce(d.text, '') = t.t"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 2, 1) END)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id, min(r.y) = d.doc_id AS kept
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

_TEMPLATES = ", ".join(f"({t}, '{label}', {exact}, {grams}, {at}, '{' '.join(words)}')" for t, label, exact, grams, at, *words in template_rows(PHRASES, NOTICES))
LICENSES = f"""
WITH t(template, label, exact, grams, place, g) AS (VALUES {_TEMPLATES}),
w AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
grams3 AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
votes AS (
  SELECT doc_id, template, label, exact, grams, pos - place AS diagonal, count(DISTINCT place) AS own, list(DISTINCT place) AS places, min(place) AS low, max(place) AS high
  FROM grams3 JOIN t USING (g) GROUP BY ALL),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER b <= {SLIP} THEN 0 ELSE 1 END AS fresh FROM votes WINDOW b AS (PARTITION BY doc_id, template ORDER BY diagonal)),
clusters AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM steps),
merged AS (
  SELECT doc_id, template, label, exact, grams, cluster, len(list_distinct(flatten(list(places)))) AS met,
    count(*) FILTER (exact AND own = grams) AS n_base, min(diagonal) FILTER (exact AND own = grams) AS first_word, max(diagonal) FILTER (exact AND own = grams) AS last_word,
    max(diagonal + high + {K - 1}) - min(diagonal + low) + 1 AS span FROM clusters GROUP BY ALL),
named AS (
  SELECT *, CASE WHEN n_base > 0 THEN label END AS base,
    CASE WHEN NOT exact AND met / grams >= {SHARE} AND span <= 1.25 * (grams + {K - 1}) OR n_base > 0 THEN label END AS said FROM merged)
SELECT w.doc_id, any_value(len(w.w)) AS n_words, coalesce(sum(n_base), 0)::BIGINT AS n_base, min(first_word) AS first_word, max(last_word) AS last_word,
  coalesce(string_agg(DISTINCT base, ',' ORDER BY base), '') AS base_labels, coalesce(string_agg(DISTINCT said, ',' ORDER BY said), '') AS labels,
  round(coalesce(max(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE met::DOUBLE / grams END), 0.0::DOUBLE), 6) AS score
FROM w LEFT JOIN named n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {ALNUM_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.g = p.g),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.l, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)"""

# Scores as contracted, from all postings of the items' terms.
RANKED = r"""
WITH found AS (SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
               FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, len(ts)::BIGINT AS n, ts FROM found WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
i AS (SELECT row_number() OVER () AS i, item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
      FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT i, t, count(*)::BIGINT AS c FROM (SELECT i, unnest(ts) AS t FROM i) GROUP BY i, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM p, s WHERE t IN (SELECT t FROM q) GROUP BY t),
h AS (SELECT r, p.t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))) AS impact
      FROM p JOIN w USING (t) JOIN d USING (r), s),
m AS (SELECT i, r, sum(c * impact)::BIGINT AS score FROM q JOIN h USING (t) GROUP BY i, r HAVING score > 0),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM m JOIN d USING (r))
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN i USING (i) WHERE rank <= 20
"""
