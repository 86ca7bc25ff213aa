"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import urls

OP10 = r"""
WITH words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT CAST(coalesce(item_id, 0) AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM words, range(1, greatest(len(w) - 9, 1) + 1) AS r(i) WHERE len(w) > 0),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT n FROM windows) s, range(1, len(w) - s.n + 2) AS r(i)),
found AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, range(0, n) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP9 = r"""
WITH pages_ AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, url FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM pages_ WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
FROM pages_ LEFT JOIN firsts USING (payload_digest)
"""


OP3 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.node = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(node) AS component_id, e.vec_id = min(node) AS kept
FROM embeddings e JOIN reach USING (vec_id) LEFT JOIN counts ON a = e.vec_id GROUP BY e.vec_id
"""


OP12 = r"""
WITH given AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
said AS (SELECT c, turn, CAST(length(text) AS BIGINT) AS chars, sha256(strlen(role) || ':' || role || text) AS said FROM given),
placed AS (SELECT c, said, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, said) AS at FROM said),
bits AS (
  SELECT c, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc
  FROM (SELECT DISTINCT c FROM given)),
ids AS (SELECT c, xor(crc, 4294967295) % 6 AS h FROM bits),
rebuilt AS (
  SELECT i.c, b.at, b.said, b.chars FROM ids i JOIN placed b ON b.c = i.c - i.c % 100 AND b.at <= i.h
  UNION ALL SELECT p.c, p.at, p.said, p.chars FROM placed p JOIN ids i ON p.c = i.c AND p.at > i.h),
whole AS (SELECT i.c, coalesce(list(r.said ORDER BY r.at) FILTER (r.said IS NOT NULL), []) AS said, coalesce(list(r.chars ORDER BY r.at) FILTER (r.said IS NOT NULL), []) AS chars FROM ids i LEFT JOIN rebuilt r ON r.c = i.c GROUP BY i.c),
starts AS (
  SELECT c, d, len(said) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars, sha256(array_to_string(said[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(said[1:d - 1], ',')) END AS parent
  FROM whole, range(0, len(said) + 1) AS r(d)),
nodes AS (
  SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM starts GROUP BY node),
children AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
own AS (SELECT x.*, coalesce(n, 0) AS n_children FROM nodes x LEFT JOIN children k ON k.parent = x.node),
below AS (
  SELECT s.node, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
  FROM own x JOIN starts s ON s.c = x.conv_id AND s.d <= x.depth GROUP BY s.node)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM own x JOIN below USING (node) LEFT JOIN nodes p ON p.node = x.parent
"""


OP13 = r"""
WITH given AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
counted AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM given),
firsts AS (SELECT text, min(doc_id) AS first FROM given GROUP BY text),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM counted JOIN firsts USING (text) LEFT JOIN said USING (doc_id)),
letter AS (SELECT i, chr(64 + i::INT) AS l FROM range(1, 6) AS r(i)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT part, good, toxic, filter_order, s AS step, o[s] AS own, fails[o[s]] AS fail, list_bool_or(list_transform(o[1:s - 1], lambda k: fails[k])) AS gone,
    list_bool_or(list_transform(o, lambda k: k <> o[s] AND fails[k])) AS others
  FROM flagged, orders, range(1, 6) AS r(s)),
counts AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, any_value(own) AS own, count(*) FILTER (NOT fail AND NOT coalesce(gone, false)) AS kept, count(*) FILTER (fail AND NOT coalesce(gone, false)) AS removed,
    count(*) FILTER (fail AND coalesce(gone, false)) AS redundant, count(*) FILTER (fail AND NOT others) AS unique_fails,
    count(*) FILTER (fail AND NOT coalesce(gone, false) AND good) AS good_lost, count(*) FILTER (fail AND NOT coalesce(gone, false) AND toxic) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counts
"""


def _op8() -> str:
    """The rules, then ten rounds of both walks written out: all of them where no walk over the edges is longer, as in the given tables."""
    fits = ", ".join(
        f"CASE WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
        f" THEN {{'length': {len(r)}, 'rule': '{r}', 'verdict': '{v}'}} END"
        for v, r in urls.RULES
    )
    d = urls.DAMPING
    rounds = "".join(
        f""", m{i} AS (SELECT kind, host, sum(score) AS score FROM (
    SELECT s.kind, s.to_host AS host, m.score * s.share AS score FROM m{i - 1} m JOIN steps s ON m.kind = s.kind AND m.host = s.host
    UNION ALL SELECT kind, host, score FROM m0) GROUP BY kind, host)"""
        for i in range(1, urls.ROUNDS + 1)
    )
    lower = f"'{urls.UPPER}', '{urls.LOWER}'"
    link = urls.LINK.replace("'", "''")
    return f"""
WITH parsed AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{urls.URL}', 1), {lower}) AS host, regexp_extract(coalesce(url, ''), '{urls.URL}', 2) AS path FROM pages),
judged AS (SELECT page_id, host, path, list_max(list_filter([{fits}], lambda x: x IS NOT NULL)) AS fit FROM parsed),
seen AS (SELECT CASE fit.verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE fit IS NOT NULL AND host <> '' GROUP BY ALL),
m0 AS (SELECT kind, host, {1 - d!r} * n / sum(n) OVER (PARTITION BY kind) AS score FROM seen),
links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda h: translate(h, {lower})))) AS dst FROM parsed
    UNION ALL SELECT array_to_string(s[k:], '.'), array_to_string(s[k + 1:], '.')
    FROM (SELECT string_split(host, '.') AS s FROM parsed WHERE NOT regexp_full_match(host, '[0-9.:]*')), range(1, len(s) - 1) AS r(k))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
ways AS (SELECT 'trust' AS kind, src AS host, dst AS to_host, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
steps AS (SELECT kind, host, to_host, {d!r} * n / sum(n) OVER (PARTITION BY kind, host) AS share FROM ways){rounds},
standing AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust
  FROM m{urls.ROUNDS} GROUP BY host)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN coalesce(distrust, 0) * {1 - urls.EQUAL!r} > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN standing USING (host)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embeddings": OP3, "op8_url_filter": _op8(), "op9_warc": OP9, "op10_decontamination": OP10, "op12_prefix_trie": OP12, "op13_filter_audit": OP13}
