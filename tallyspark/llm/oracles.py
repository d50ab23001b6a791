"""DuckDB SQL for the operators whose results SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, n, i, item_id FROM places JOIN windows USING (win, n)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

_ESCAPED = r"replace(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b'), ']', '\r')"

OP8 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, length({_ESCAPED}) + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
    ELSE 16 + length({_ESCAPED.replace("text", "role")}) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY 1, 2)
  JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN reach ON reach.a = d.r LEFT JOIN d o ON o.r = reach.b
GROUP BY d.r, d.doc_id, n.n
"""



def _level(i: int) -> str:
    """The tree's nodes with one more segment, from those of n{i}."""
    x = f"s[{i + 1}]"
    return f"""
c{i} AS (SELECT host, t, {x} AS x, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM n{i} WHERE {x} IS NOT NULL GROUP BY ALL),
k{i} AS (
  SELECT host, t, x FROM (SELECT *, sum(n) OVER w AS an, sum(l) OVER w AS al, sum(b) OVER w AS ab, count(*) OVER w AS k FROM c{i} WINDOW w AS (PARTITION BY host, t))
  WHERE k = 1 OR (n * 16 >= an AND CAST(l AS DOUBLE) * (al - l) * ab * (al - ab) > 0
    AND CAST(b * ((al - l) - (ab - b)) - (ab - b) * (l - b) AS DOUBLE) ** 2 * al >= 3.841 * (CAST(l AS DOUBLE) * (al - l) * ab * (al - ab)))),
n{i + 1} AS (
  SELECT a.host, a.shape, a.s, CASE WHEN a.{x} IS NULL THEN a.t ELSE a.t || '/' || CASE WHEN k.x IS NULL THEN '*' ELSE k.x END END AS t, n, l, b
  FROM n{i} a LEFT JOIN k{i} k ON k.host = a.host AND k.t = a.t AND k.x = a.{x}),"""


OP11 = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS shape FROM p),
g AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
n0 AS (SELECT host, shape, string_split(shape, '/')[2:] AS s, '' AS t, count(*) AS n, count(bad) AS l, sum(coalesce(bad, 0)) AS b FROM q LEFT JOIN g ON doc_id = page_id GROUP BY host, shape),
{"".join(map(_level, range(4)))}
m AS (SELECT host, shape, CASE WHEN len(s) > 4 THEN t || '/**' ELSE t END AS template, l, b FROM n4),
h AS (SELECT host, sum(l) AS l, sum(b) AS b FROM m GROUP BY host),
o AS (SELECT CASE WHEN sum(l) > 0 THEN CAST(sum(b) AS DOUBLE) / sum(l) ELSE 0 END AS rate FROM h),
j AS (
  SELECT m.host, m.template, (sum(m.b) + 4.0::DOUBLE * max((h.b + 4.0::DOUBLE * o.rate) / (h.l + 4.0::DOUBLE))) / (sum(m.l) + 4.0::DOUBLE) AS purity
  FROM m JOIN h ON h.host = m.host CROSS JOIN o GROUP BY m.host, m.template),
v AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) x (name, start, says)),
w AS (
  SELECT page_id, arg_max(name || start, length(name || start)) AS rule, arg_max(says, length(name || start)) AS says
  FROM q JOIN v ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT q.page_id, q.host, path, rule, coalesce(says, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, m.template
FROM q JOIN m USING (host, shape) JOIN j ON j.host = m.host AND j.template = m.template LEFT JOIN w ON w.page_id = q.page_id
"""

OP12 = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def _before(state: int) -> str:
    """The least weight of a state before a row: a cost of twelve digits, then letters, so that strings order as (cost, letters)."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def put(cost: str, letters: str, to: int) -> str:
        return f"lpad(CAST(CAST(left(v{to}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{letters}' || substr(v{to}, 13)"

    def kept(cost: str, letters: str, at: int) -> str:
        fits = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[at]
        return "CASE left(r.role, 1) " + " ".join(f"WHEN '{k}' THEN {put(cost, letters, to)}" for k, to in fits) + " END"

    at = after[state]
    ways = [kept("5 * r.truncated", "K", state), put("1 + 5 * r.truncated", "R", at), kept("5 + 5 * r.truncated", "IK", at), put("6 + 5 * r.truncated", "IR", after[at])]
    return f"CASE WHEN r.gone = 1 THEN {put('2', 'D', state)} ELSE least({put('2', 'D', state)}, {', '.join(ways)}) END AS v{state}"


_CRC = """xor(list_reduce(flatten(list_transform(string_split(k, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""

OP13 = rf"""
WITH RECURSIVE c AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
f AS (SELECT *, {_CRC} % 20 AS f FROM c),
d AS (
  SELECT g, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) FROM f WHERE f <> 0),
n AS (SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
r AS (
  SELECT g, turn, role, text, i, lead(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS following,
    CAST(NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS INTEGER) AS blank,
    CAST(row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AND regexp_matches(text, '[^\x20\x09-\x0D]') AS INTEGER) AS again,
    greatest(CAST(NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS INTEGER), CAST(row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS INTEGER)) AS gone,
    CAST(NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS INTEGER) AS truncated FROM n),
w AS (
  SELECT g, max(i) + 1 AS i, lpad('', 12, '0') AS v0, lpad('10', 12, '0') || 'II' AS v1, lpad('5', 12, '0') || 'I' AS v2, lpad('', 12, '0') AS v3 FROM r GROUP BY g
  UNION ALL
  SELECT w.g, r.i, {_before(0)}, {_before(1)}, {_before(2)}, {_before(3)} FROM w JOIN r ON r.g = w.g AND r.i = w.i - 1),
best AS (SELECT g, CAST(left(v0, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM w WHERE i = 1),
told AS (
  SELECT g, audit, 1 AS p, 1 AS i, '' AS last, CAST(NULL AS VARCHAR) AS story FROM best
  UNION ALL
  SELECT t.g, t.audit, t.p + 1, t.i + CASE WHEN x = 'I' THEN 0 ELSE 1 END,
    CASE x WHEN 'D' THEN t.last WHEN 'K' THEN left(r.role, 1) ELSE CASE WHEN t.last = 'u' THEN 'a' ELSE 'u' END END,
    CASE x WHEN 'D' THEN t.story ELSE concat_ws(chr(10), t.story,
      CASE WHEN x = 'K' THEN r.role WHEN t.last = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE x WHEN 'I' THEN '' ELSE r.text END) END
  FROM (SELECT *, substr(audit, CAST(p AS BIGINT), 1) AS x FROM told WHERE p <= length(audit)) t LEFT JOIN r ON r.g = t.g AND r.i = t.i),
s AS (
  SELECT g, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(again) AS BIGINT) AS duplicate,
    CAST(sum(CASE WHEN gone = 0 THEN truncated ELSE 0 END) AS BIGINT) AS truncated,
    CAST(sum(CASE WHEN following IS NOT NULL AND left(role, 1) || following NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS BIGINT) AS illegal FROM r GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(story, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM c) LEFT JOIN s USING (g) LEFT JOIN best USING (g) LEFT JOIN told ON told.g = best.g AND told.p = length(best.audit) + 1
"""

ORACLES = {"op3_decontaminate": OP3, "op8_chat_events": OP8, "op9_ngram_join": OP9, "op11_url_templates": OP11, "op12_rtree_negatives": OP12, "op13_structure_repair": OP13}
