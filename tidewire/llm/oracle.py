"""DuckDB SQL of the queries that SQL can express."""

ORACLE = {}

ORACLE["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (
  SELECT doc_id, unnest(generate_series(1, len(ws) - 34)) AS p, ws FROM w WHERE len(ws) >= 35),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h FROM starts),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
words AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS word FROM w WHERE len(ws) > 0),
marked AS (
  SELECT words.doc_id, words.p, word,
         max(rep.p) OVER (PARTITION BY words.doc_id ORDER BY words.p) AS last_start
  FROM words LEFT JOIN rep ON rep.doc_id = words.doc_id AND rep.p = words.p),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM marked WHERE last_start IS NULL OR p - last_start > 34 GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

ORACLE["op7_minhash_dedup"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')))
    END AS sh FROM t),
e AS (SELECT DISTINCT doc_id, unnest(sh) AS g, len(sh) AS n FROM s),
-- a shingle shared by one document only makes no pair; prefix filter: the rarest
-- shingles of a set, as many as a partner of 80 % must share one of
f AS (SELECT e.*, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r
      FROM e JOIN (SELECT g, count(*) AS c FROM e GROUP BY g) USING (g)),
p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y
      FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE a.r <= a.n - (80 * a.n + 99) // 100 + 1 AND b.r <= b.n - (80 * b.n + 99) // 100 + 1
        AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
      WHERE 100 * len(list_intersect(a.sh, b.sh))
            >= 80 * (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)))),
both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON c.doc_id = s.doc_id
"""

ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

ORACLE["op10_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
                + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
                + length('<|im_start|>') + length('<|im_end|>') + 2 AS size FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_RULES = {  # kind: pattern, the group whose length counts, the least length
    "assign": ("(" + _either_case("password|passwd|secret|token|api_?key")
               + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
    "private": ("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    "github": ("gh[opsru]_[A-Za-z0-9]+", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
}


def _matches(rank: int, kind: str) -> str:
    """Matches of a rule: a match starts after the pieces and matches before it."""
    pattern, group, least = _RULES[kind]
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(m[i]) AS e FROM (
    SELECT doc_id, m, g, i, list_sum(list_transform(p[:i], lambda x: length(x)))
                            + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, {quoted}, 0) AS m, regexp_extract_all(t, {quoted}, {group}) AS g,
             string_split_regex(t, {quoted}) AS p FROM d)))
  WHERE length(g[i]) >= {least}"""


ORACLE["op11_secret_scans"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_matches(i, k) for i, k in enumerate(_RULES))}),
j AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat_ws(':', kind, s::BIGINT, e::BIGINT), ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(concat_ws(':', kind, s::BIGINT, e::BIGINT), ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON j.doc_id = d.doc_id
"""

ORACLE["op12_fill_in_middle"] = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (
  SELECT doc_id, t, us, len(us)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (
  SELECT doc_id, t, n, us, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, t, n, form, array_to_string(us[:a], '') AS x, array_to_string(us[a + 1:b], '') AS y,
         array_to_string(us[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', x, '<S>', z, '<M>', y)
                        ELSE concat('<S>', z, '<P>', x, '<M>', y) END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
