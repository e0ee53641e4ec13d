"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from . import urlfilter as U

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = f"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
often AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.*, coalesce(doc_id <> last, false) AS gone FROM lines l LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (k) WHERE m < doc_id)),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def _parsed(src: str) -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return f"""(SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
           FROM (SELECT *, coalesce({rest}, '') AS rest FROM {src}))"""


def _buckets() -> str:
    grams = ", ".join(f"list_transform(range(1, greatest(length({s}) - {n - 2}, 1)), lambda i: substr({s}, i, {n}))" for s in ("('^' || host || '$')", "('>' || path || '<')") for n in (3, 4, 5))
    return f"list_sort(list_distinct(list_transform(flatten([{grams}]), lambda g: ('0x' || substr(md5(g), 1, 7))::BIGINT % {U.DIM})))"


def _rules() -> tuple[str, str]:
    whens = []
    for action, text in sorted(U.RULES, key=lambda r: (-len(r[1]), r[1])):
        host, path = text.split("/", 1)
        whens.append((f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}') THEN", text, action))
    return tuple("CASE " + " ".join(f"{w[0]} '{w[k]}'" for w in whens) + " END" for k in (1, 2))


OP3 = f"""
WITH RECURSIVE seed AS (SELECT * FROM (VALUES {", ".join(f"('{u}', {y}::DOUBLE)" for u, y in U.SEED)}) v(url, y)),
ex AS (SELECT url, y, {_buckets()} AS b FROM {_parsed("seed")}),
known AS (SELECT list_sort(list_distinct(flatten(list(b)))) AS known FROM ex),
shaped AS (
  SELECT known, list(y ORDER BY url) AS y, list(1 / sqrt(greatest(1, len(b))) ORDER BY url) AS s,
         list(list_transform(b, lambda k: list_position(known, k)) ORDER BY url) AS x
  FROM ex, known GROUP BY known),
cols AS (SELECT list(r ORDER BY j) AS col FROM (
  SELECT j, list(i ORDER BY i) AS r FROM (SELECT i, unnest(x[i]) AS j FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM shaped)) GROUP BY j)),
run AS (
  SELECT 0 AS it, list_transform(known, lambda k: 0.0::DOUBLE) AS v, 0.0::DOUBLE AS bias FROM shaped
  UNION ALL
  SELECT it + 1, list_transform(range(1, len(v) + 1), lambda j: v[j] + {U.RATE}::DOUBLE * (list_sum(list_transform(col[j], lambda i: s[i] * e[i])) / len(y) * 30 - {U.RIDGE}::DOUBLE * v[j])),
         bias + {U.RATE}::DOUBLE * list_sum(e) / len(y)
  FROM (SELECT run.*, shaped.*, col, list_transform(range(1, len(y) + 1), lambda i: y[i] - 1 / (1 + exp(-(bias + s[i] * list_sum(list_transform(x[i], lambda j: v[j])))))) AS e
        FROM run, shaped, cols WHERE it < {U.STEPS})),
model AS (SELECT unnest(known) AS k, unnest(v) AS w FROM run, shaped WHERE it = {U.STEPS}),
bias AS (SELECT bias FROM run WHERE it = {U.STEPS}),
p AS (SELECT row_number() OVER () AS r, page_id, host, path, {_buckets()} AS b FROM {_parsed("pages")}),
score AS (SELECT r, sum(w) AS total FROM (SELECT r, unnest(b) AS k FROM p) JOIN model USING (k) GROUP BY r)
SELECT page_id, host, path, {_rules()[0]} AS rule,
       coalesce({_rules()[1]}, CASE WHEN bias + coalesce(total, 0) / sqrt(greatest(1, len(b))) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN score USING (r), bias"""


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH held AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
lengths AS (SELECT r, doc_id, len(ws) AS n FROM held WHERE len(ws) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS t FROM held) GROUP BY r, t),
asked AS (SELECT q, item_id, t, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY q, item_id, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
            FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), total),
parts AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))) AS part
          FROM tf JOIN lengths USING (r) JOIN weights USING (t), total WHERE t IN (SELECT t FROM asked)),
scores AS (SELECT q, item_id, doc_id, r, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN parts USING (t) JOIN lengths USING (r) GROUP BY q, item_id, doc_id, r HAVING score > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best WHERE rank <= 20"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = f"""xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT),
    lambda a, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {_BIT}, xor(a, b)), 4294967295::BIGINT), 4294967295)"""

#: A tag stands for the source: '' for null, else 's' and the source.
OP12 = rf"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS tag, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tag) AS n FROM leaves),
nodes AS (
  SELECT tag, 0 AS lvl, idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tag, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tag, lvl, idx // 3, n),
subroots AS (SELECT tag, digest AS subroot, row_number() OVER (ORDER BY encode(tag)) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, place AS idx, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, idx // 3, n),
every AS (SELECT tag, lvl, idx, digest, n FROM nodes UNION ALL SELECT NULL, lvl, idx, digest, n FROM tops),
sides AS (
  SELECT tag, lvl, idx, n,
         coalesce(string_agg(digest, '') OVER (PARTITION BY tag, lvl, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(digest, '') OVER (PARTITION BY tag, lvl, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM every),
walk AS (
  SELECT r, tag, 0 AS lvl, idx, n, tampered AS d, '' AS p FROM placed
  UNION ALL
  SELECT r, w.tag, w.lvl + 1, w.idx // 3, (w.n + 2) // 3, sha256(lft || d || rgt), p || lft || rgt
  FROM walk w JOIN (SELECT * FROM sides WHERE tag IS NOT NULL) s ON w.tag = s.tag AND w.lvl = s.lvl AND w.idx = s.idx WHERE w.n > 1),
climb AS (
  SELECT r, 0 AS lvl, place AS idx, s.n AS n, d, p FROM walk w JOIN subroots s ON w.tag = s.tag WHERE w.n = 1
  UNION ALL
  SELECT r, c.lvl + 1, c.idx // 3, (c.n + 2) // 3, sha256(lft || d || rgt), p || lft || rgt
  FROM climb c JOIN (SELECT * FROM sides WHERE tag IS NULL) s ON c.lvl = s.lvl AND c.idx = s.idx WHERE c.n > 1),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, d AS folded_root, d = root AS verified
FROM leaves JOIN climb USING (r) JOIN subroots USING (tag), root WHERE climb.n = 1"""
