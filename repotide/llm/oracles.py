"""The registered operators that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from repotide.llm.licenses import BASE, BLOCK, PERCENT, SHORT, STEP, TEMPLATES, needed, words_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH item AS (SELECT item_id::varchar AS item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[pos + 1 : pos + size], ' ') AS key
        FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS pos FROM item)),
doc AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT uid, size, pos, array_to_string(w[pos + 1 : pos + size], ' ') AS key
          FROM (SELECT uid, w, size, unnest(range(0, len(w) - size + 1)) AS pos
                FROM doc, (SELECT DISTINCT size FROM item) WHERE len(w) >= size)),
hit AS (SELECT uid, pos, size, item_id FROM place JOIN win USING (size, key)),
words AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT uid, pos, size FROM hit)) GROUP BY uid),
items AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT uid, item_id FROM hit) GROUP BY uid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)
"""


def _template_rows() -> str:
    rows = []
    for t in TEMPLATES:
        words = words_of(t.text)
        own = sorted(set(words))
        quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
        rows.append(f"('{t.label}', {quoted(words)}, {quoted(own)}, {len(own)}, {needed(len(own), PERCENT, SHORT)}, {str(t.phrase).lower()}, {str(t.text in BASE).lower()})")
    return ",\n  ".join(rows)


LICENSES = f"""
WITH template(label, words, own, size, least, phrase, base) AS (VALUES
  {_template_rows()}),
doc AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
block AS (SELECT uid, list_distinct(w[k * {STEP} + 1 : k * {STEP} + {BLOCK}]) AS b
          FROM (SELECT uid, w, unnest(range(0, greatest(0, (len(w) - {BLOCK} + {STEP - 1}) // {STEP}) + 1)) AS k FROM doc)),
held AS (SELECT uid, label, max(len(list_intersect(b, own)) / size) AS score FROM block, template
         WHERE NOT phrase AND len(list_intersect(b, own)) >= least GROUP BY uid, label),
place AS (SELECT uid, label, base, pos FROM (SELECT uid, w, label, words, base, unnest(range(0, len(w) - len(words) + 1)) AS pos
          FROM doc, template WHERE phrase AND len(w) >= len(words) AND list_contains(w, words[1])) WHERE w[pos + 1 : pos + len(words)] = words),
based AS (SELECT uid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM place WHERE base GROUP BY uid),
base_names AS (SELECT uid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT uid, label FROM place WHERE base) GROUP BY uid),
names AS (SELECT uid, string_agg(label, ',' ORDER BY label) AS labels
          FROM (SELECT uid, label FROM place UNION SELECT uid, label FROM held) GROUP BY uid),
best AS (SELECT uid, max(score) AS score FROM (SELECT uid, score FROM held UNION ALL SELECT uid, 1.0::double FROM place) GROUP BY uid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
       coalesce(base_names.labels, '') AS base_labels, coalesce(names.labels, '') AS labels, coalesce(score, 0)::double AS score
FROM doc LEFT JOIN based USING (uid) LEFT JOIN base_names USING (uid) LEFT JOIN names USING (uid) LEFT JOIN best USING (uid)
"""

PREFIX_TRIE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(list_reduce(
        flatten(list_transform(string_split(conv_id::varchar, ''), lambda s: [ascii(s)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::bigint), 4294967295::bigint) % 4 AS h FROM own),
r AS (SELECT c.conv_id, d.p + 1 AS depth, d.role, d.text FROM c JOIN t d ON d.conv_id = c.donor AND d.p < c.h
      UNION ALL
      SELECT c.conv_id, t.p - c.h + least(c.h, coalesce(own.n, 0)) + 1, t.role, t.text
      FROM c JOIN t ON t.conv_id = c.conv_id AND t.p >= c.h LEFT JOIN own ON own.conv_id = c.donor),
k AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
             string_agg(md5(len(role)::varchar || ':' || role || text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT path, depth, left(path, (greatest(depth - 1, 0) * 32)::bigint) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words
         FROM k GROUP BY path, depth),
kids AS (SELECT parent AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY parent),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.path = node.path),
under AS (SELECT a.path, sum((f.n_convs - 1) * f.words) AS saved, sum((f.n_children = 0)::bigint) AS leaves
          FROM full_node f JOIN k a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.path),
last AS (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id),
ends AS (SELECT k.path, string_agg(k.conv_id::varchar, ',' ORDER BY k.conv_id) AS ids FROM k JOIN last USING (conv_id, depth) GROUP BY k.path)
SELECT f.conv_id, f.depth::bigint AS depth, CASE WHEN f.depth > 0 THEN up.conv_id END AS parent_conv_id, f.n_convs::bigint AS n_convs,
       f.n_children::bigint AS n_children, under.leaves::bigint AS n_leaves, under.saved::bigint AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM full_node f JOIN node up ON up.path = f.parent JOIN under ON under.path = f.path LEFT JOIN ends ON ends.path = f.path
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::bigint AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::int AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""

ORACLES = {
    "op1_decontamination": DECONTAMINATION,
    "op11_license_scan": LICENSES,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_hard_negatives": HARD_NEGATIVES,
}
