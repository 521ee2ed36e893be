"""DuckDB SQL for the rows of operators 11 to 13."""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item, w[k:k + least(len(w), 10) - 1] AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)
), l AS (
  SELECT DISTINCT len(g) AS l FROM g
), o AS (
  SELECT r, k, l, w[k:k + l - 1] AS g
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, l WHERE len(w) >= l)
), h AS (
  SELECT r, k, l, item FROM o JOIN g USING (g)
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS p FROM h) GROUP BY r
), s AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""

OP12 = r"""
WITH p AS (
  SELECT r, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (
    SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
  )
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, s AS words, array_to_string(w[i:i + s - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(s) WHERE len(w) >= s)
  GROUP BY ALL HAVING count(*) >= 10
), cut AS (
  SELECT lang, words, phrase, f AS a, k, string_split(phrase, ' ') AS w
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1)
), scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, k, x.f AS l, y.f AS r,
    ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT *, unnest([1, 2]) AS i FROM f WHERE words = 3) GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase AND b.words = 2
  WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

# crc32 of the decimal id, bit by bit, gives the turns taken over.
OP11 = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, cell) AS p, cell, size
  FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS size,
      md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS cell
    FROM conversations WHERE conv_id IS NOT NULL
  )
), c AS (
  SELECT c, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(0, 8 * length(s)), lambda i: i::BIGINT)),
    lambda a, i: CASE
      WHEN (CASE WHEN i % 8 = 0 THEN xor(a, ascii(s[(i // 8 + 1)::INT])::BIGINT) ELSE a END) & 1 = 1
      THEN xor((CASE WHEN i % 8 = 0 THEN xor(a, ascii(s[(i // 8 + 1)::INT])::BIGINT) ELSE a END) >> 1, 3988292384)
      ELSE (CASE WHEN i % 8 = 0 THEN xor(a, ascii(s[(i // 8 + 1)::INT])::BIGINT) ELSE a END) >> 1 END
  )) % 9 AS h
  FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM t)
), r AS (
  SELECT c.c, 0 AS part, p, cell, size FROM c JOIN t ON t.c = c.c - c.c % 5 AND p <= h
  UNION ALL SELECT c.c, 1, p, cell, size FROM c JOIN t ON t.c = c.c AND p > h
), q AS (
  SELECT c, row_number() OVER w AS d, size, md5(string_agg(cell, '') OVER w) AS key
  FROM r WINDOW w AS (PARTITION BY c ORDER BY part, p ROWS UNBOUNDED PRECEDING)
), path AS (
  SELECT q.c, d, size, key, lag(key, 1, '') OVER (PARTITION BY q.c ORDER BY d) AS up, max(d) OVER (PARTITION BY q.c) AS last FROM q
  UNION ALL SELECT c, 0, 0, '', NULL, coalesce(m, 0) FROM c LEFT JOIN (SELECT c, max(d) AS m FROM q GROUP BY c) USING (c)
), node AS (
  SELECT key, d, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(size) AS own,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last), '') AS ends
  FROM path GROUP BY key, d
), kid AS (
  SELECT up AS key, count(*) AS kids FROM node WHERE up IS NOT NULL GROUP BY up
), sub AS (
  SELECT a.key, sum(v.own) AS saved, count(*) FILTER (kids IS NULL) AS leaves
  FROM node v LEFT JOIN kid ON kid.key = v.key JOIN path a ON a.c = v.c AND a.d <= v.d GROUP BY a.key
)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n LEFT JOIN node u ON u.key = n.up LEFT JOIN kid ON kid.key = n.key JOIN sub ON sub.key = n.key
"""
