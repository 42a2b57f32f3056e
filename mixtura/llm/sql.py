"""DuckDB SQL of the operators on conversations and vectors, by plainer means than the operators use."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295)"


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own
), len AS (
  SELECT conv_id AS base, count(*) AS n FROM own GROUP BY 1
), convs AS (
  SELECT conv_id, base, h, least(h, coalesce(n, 0)) AS m FROM ids LEFT JOIN len USING (base)
), turns AS (
  SELECT c.conv_id, place + 1 AS depth, role, text FROM own o JOIN convs c ON o.conv_id = c.base AND place < m
  UNION ALL SELECT conv_id, m + place - h + 1, role, text FROM own JOIN convs USING (conv_id) WHERE place >= h
), keyed AS (
  SELECT conv_id, depth, text, string_agg(sha256(concat(length(role), ':', role, text)), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS k FROM turns
), paths AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS b, k FROM keyed UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), mine AS (
  SELECT conv_id AS c, depth, b, min(conv_id) OVER w AS node, count(*) OVER w AS n FROM paths WINDOW w AS (PARTITION BY depth, k)
), nodes AS (
  SELECT x.c AS conv_id, x.depth, p.node AS parent_conv_id, x.n AS n_convs, (x.n - 1) * x.b AS saved FROM mine x LEFT JOIN mine p ON p.c = x.c AND p.depth = x.depth - 1 WHERE x.c = x.node
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT nodes.*, coalesce(k, 0) AS n_children FROM nodes LEFT JOIN kids USING (conv_id, depth)
), rolled AS (
  SELECT a.node AS conv_id, a.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum(f.saved) AS BIGINT) AS saved_tokens
  FROM full_nodes f JOIN mine a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY ALL
), ends AS (
  SELECT node AS conv_id, depth, string_agg(c, ',' ORDER BY c) AS s FROM (SELECT *, max(depth) OVER (PARTITION BY c) AS last FROM mine) WHERE depth = last GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(s, '')) AS ends_sha256
FROM full_nodes JOIN rolled USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""


def _plus(way: str, price: str, edit: str) -> str:
    """A way (ten digits of cost, then its audit) with one more edit."""
    return f"(lpad(CAST(CAST(substr({way}, 1, 10) AS BIGINT) + {price} AS VARCHAR), 10, '0') || substr({way}, 11) || '{edit}')"


_REROLED = {2: ("w0", "w1", "w3"), 3: ("w2",)}
_KEPT = {1: (("w0", "s"),), 2: (("w0", "u"), ("w1", "u"), ("w3", "u")), 3: (("w2", "a"),)}


def _after(q: int) -> str:
    """The best way to a state by the next row's edit, before insertions. ``code`` is as in the operator."""
    ways = [_plus(f"w{q}", "4", "D")]
    ways += [f"CASE WHEN code <> '-' THEN {_plus(w, '3 + worn', 'R')} END" for w in _REROLED.get(q, ())]
    ways += [f"CASE WHEN lower(code) = '{r}' THEN {_plus(w, 'worn', 'K')} END" for w, r in _KEPT.get(q, ())]
    return f"least({', '.join(ways)}, NULL)"


#: Insertions lead to user from all other states, and from there to assistant.
_INSERTED = f"x0 AS w0, x1 AS w1, least(x2, {_plus('x0', '3', 'I')}, {_plus('x1', '3', 'I')}, {_plus('x3', '3', 'I')}) AS w2"

REPAIR_SQL = f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("concat(conv_id, ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS how FROM conversations WHERE conv_id IS NOT NULL
), done AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS again FROM hit WHERE how <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS trimmed FROM done
), marked AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS then_initial FROM placed
), coded AS (
  SELECT conv_id, place, role, text, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' ELSE initial END AS code, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS worn FROM marked
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (then_initial IS NOT NULL AND concat(initial, then_initial) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY 1
), run AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, lpad('', 10, '0') AS w0, CAST(NULL AS VARCHAR) AS w1, '0000000003I' AS w2, '0000000006II' AS w3 FROM stats
  UNION ALL
  SELECT conv_id, i, w0, w1, w2, least(x3, {_plus("w2", "3", "I")}) AS w3 FROM (
    SELECT conv_id, i, {_INSERTED}, x3 FROM (
      SELECT run.conv_id, i + 1 AS i, {", ".join(f"{_after(q)} AS x{q}" for q in range(4))} FROM run JOIN coded ON coded.conv_id = run.conv_id AND coded.place = i
    )
  )
), best AS (
  SELECT conv_id, CAST(substr(least(w0, w3), 1, 10) AS BIGINT) AS cost, substr(least(w0, w3), 11) AS audit FROM run JOIN stats USING (conv_id) WHERE i = n
), walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i, '0' AS q, CAST(NULL AS VARCHAR) AS line FROM best
  UNION ALL
  SELECT w.conv_id, k + 1, w.i + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
    CASE WHEN e = 'D' THEN q WHEN e = 'K' THEN c.code WHEN q = 'u' THEN 'a' ELSE 'u' END,
    CASE e WHEN 'D' THEN NULL WHEN 'K' THEN c.role || ':' || c.text WHEN 'R' THEN CASE WHEN q = 'u' THEN 'assistant:' ELSE 'user:' END || c.text ELSE CASE WHEN q = 'u' THEN 'assistant:' ELSE 'user:' END END
  FROM (SELECT *, substr(audit, k, 1) AS e FROM walk JOIN best USING (conv_id) WHERE k <= length(audit)) w LEFT JOIN coded c ON c.conv_id = w.conv_id AND c.place = w.i
), texts AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM walk GROUP BY 1
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) ids LEFT JOIN stats USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN texts USING (conv_id)
"""
