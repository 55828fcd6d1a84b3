"""DuckDB oracle SQL for the registered queries.

The derived fixture tables are rebuilt as CTEs from the pre-registered base
views (documents, pages, events, conversations, part, nation ...) with the
same id rules as ``tidewire.sources.fixtures``.  Each oracle is an
independent, straightforward SQL formulation (window functions, recursive
CTE for components) — not a transcription of the Spark plan.
"""

from __future__ import annotations

from tidewire import config as C

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def _minutes_before(expr: str) -> str:
    return f"({AS_OF} - to_minutes(CAST({expr} AS BIGINT)))"


def _pick(values: list[str], idx: str) -> str:
    return "(" + "[" + ", ".join(_q(v) for v in values) + f"])[({idx}) + 1]"


FIXTURE_CATEGORIES = ["Politics", "Business", "Sports", "Technology",
                      "Culture", "Local", "Regional", "World"]

# ---------------------------------------------------------------------------
# classification expressions generated from the same config
# ---------------------------------------------------------------------------


def _topic_text(title: str = "title", summary: str = "summary") -> str:
    return f"lower(coalesce({title}, '') || ' ' || coalesce({summary}, ''))"


def _relevant(t: str) -> str:
    kws = sorted({kw for _, ks in C.TAXONOMY for kw in ks})
    return "(" + " OR ".join(f"instr({t}, {_q(k)}) > 0" for k in kws) + ")"


def _category(t: str) -> str:
    hits = ["(" + " + ".join(f"CASE WHEN instr({t}, {_q(k)}) > 0 THEN 1 ELSE 0 END" for k in kws) + ")"
            for _, kws in C.TAXONOMY]
    top = "greatest(" + ", ".join(hits) + ")"
    whens = " ".join(f"WHEN {h} = {top} THEN {_q(cat)}" for h, (cat, _) in zip(hits, C.TAXONOMY))
    return f"(CASE WHEN {top} = 0 THEN {_q(C.FALLBACK_CATEGORY)} {whens} END)"


def _tokens(col: str) -> str:
    return ("list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(coalesce("
            f"{col}, '')), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: length(w) >= {C.MIN_TOKEN_LEN})))")


# ---------------------------------------------------------------------------
# fixture CTEs
# ---------------------------------------------------------------------------

CTE = {}

CTE["art"] = f"""art AS (
  SELECT doc_id AS id, source, CAST(substr(source, 4) AS INTEGER) AS source_ord, doc_id AS item_ord,
         'https://news.example.com/' || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS url,
         sha256('https://news.example.com/' || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS VARCHAR)) AS url_hash,
         split_part(text, chr(10), 1) AS title, text AS summary,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {_minutes_before('(doc_id * 37) % 2160')} END AS published_at,
         {_minutes_before('(doc_id % 30) * 60')} AS fetched_at,
         text AS raw_content
  FROM documents)"""

CTE["ing"] = f"""ing AS (
  SELECT f.*, {_category(_topic_text())} AS category
  FROM (SELECT * FROM art WHERE url IS NOT NULL AND url <> ''
        QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY source_ord, item_ord) = 1) f
  WHERE (published_at IS NULL OR published_at >= {AS_OF} - INTERVAL {C.MAX_AGE_HOURS} HOUR)
    AND {_relevant(_topic_text())})"""

CTE["win"] = f"""win AS (SELECT * FROM ing WHERE fetched_at >= {AS_OF} - INTERVAL {C.LOOKBACK_HOURS} HOUR)"""

CTE["reps"] = f"""sets AS (SELECT id, {_tokens('title')} AS tokens FROM win),
reps AS (SELECT tokens, min(id) AS rep, count(*) AS copies, len(tokens) AS n
         FROM sets WHERE len(tokens) > 0 GROUP BY tokens),
cmap AS (SELECT s.id, r.rep FROM sets s JOIN reps r ON s.tokens = r.tokens)"""

CTE["pairs"] = f"""rt AS (SELECT rep, n, unnest(tokens) AS tok FROM reps),
pairs AS (
  SELECT a.rep AS id_a, b.rep AS id_b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS n_inter
  FROM rt a JOIN rt b ON a.tok = b.tok AND a.rep < b.rep
  GROUP BY a.rep, b.rep
  HAVING {C.JACCARD_DEN} * count(*) >= {C.JACCARD_NUM} * (any_value(a.n) + any_value(b.n) - count(*)))"""

CTE["comp"] = """edges AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id, rep FROM cmap WHERE id <> rep),
und AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, label) AS (
  SELECT id, id FROM win
  UNION
  SELECT u.b, r.label FROM reach r JOIN und u ON r.node = u.a),
comp AS (SELECT node AS id, min(label) AS story_group_id FROM reach GROUP BY node)"""

CTE["grp"] = """grp0 AS (SELECT w.*, c.story_group_id FROM win w JOIN comp c ON w.id = c.id),
grp AS (
  SELECT *, CASE WHEN id = first_value(id) OVER (PARTITION BY story_group_id
                   ORDER BY length(coalesce(summary, '')) DESC, id ASC) THEN 0 ELSE 1 END AS is_duplicate
  FROM grp0)"""

_AUTH_VALUES = ", ".join(f"({_q(s)}, CAST({w} AS DOUBLE))" for s, w in C.AUTHORITY)
_BOOSTED = ", ".join(_q(c) for c in C.BOOSTED_CATEGORIES)

CTE["sc"] = f"""sizes AS (SELECT story_group_id, count(*) AS group_size FROM grp
          WHERE story_group_id IS NOT NULL GROUP BY story_group_id),
auth(source, weight) AS (VALUES {_AUTH_VALUES}),
sc0 AS (
  SELECT g.*, s.group_size,
    CASE WHEN published_at IS NULL THEN CAST({C.RECENCY_UNKNOWN} AS DOUBLE)
         WHEN epoch_us({AS_OF}) - epoch_us(published_at) < {C.RECENT_HOURS * 3600 * 1_000_000}
         THEN CAST({C.RECENCY_FRESH} AS DOUBLE) ELSE CAST({C.RECENCY_OLD} AS DOUBLE) END AS recency,
    coalesce(au.weight, CAST({C.DEFAULT_AUTHORITY} AS DOUBLE)) AS authority,
    CASE WHEN coalesce(s.group_size, 1) > 1 THEN CAST({C.GROUP_BONUS} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS bonus,
    CASE WHEN category IN ({_BOOSTED}) THEN CAST({C.CATEGORY_BOOST} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS boost
  FROM grp g LEFT JOIN sizes s ON g.story_group_id = s.story_group_id
  LEFT JOIN auth au ON g.source = au.source
  WHERE coalesce(g.is_duplicate, 0) = 0),
sc AS (SELECT *, round(recency + authority + bonus + boost, 3) AS priority_score,
         story_group_id IS NOT NULL AND coalesce(group_size, 1) > 1 AS is_multi_source FROM sc0)"""

CTE["feed"] = f"""feed AS (
  SELECT id, source, source_ord, item_ord,
    CASE WHEN id % 41 = 0 THEN '' WHEN id % 43 = 0 THEN NULL ELSE url END AS link,
    '  ' || title || ' ' AS title, summary,
    CASE WHEN published_at IS NULL THEN NULL
         WHEN id % 4 = 0 THEN strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' +0000'
         WHEN id % 4 = 1 THEN strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' GMT'
         WHEN id % 4 = 2 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%SZ')
         ELSE 'sometime ' || CAST(id AS VARCHAR) END AS published
  FROM art)"""

# CTE dependencies, in definition order
DEPS = {
    "art": [], "ing": ["art"], "win": ["ing"], "reps": ["win"], "pairs": ["reps"],
    "comp": ["pairs"], "grp": ["comp"], "sc": ["grp"], "feed": ["art"],
}


def with_(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(CTE[n] for n in order) + "\n"


ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------------------
# ingest
# ---------------------------------------------------------------------------

ORACLE["w1_first_seen"] = with_("art") + """SELECT id, url, source FROM art
QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY source_ord, item_ord) = 1"""

ORACLE["f1_has_link"] = with_("feed") + "SELECT id, link FROM feed WHERE link IS NOT NULL AND link <> ''"

ORACLE["f2_fresh"] = with_("art") + f"""SELECT id, {_ts('published_at')} AS published_at FROM art
WHERE published_at IS NULL OR published_at >= {AS_OF} - INTERVAL {C.MAX_AGE_HOURS} HOUR"""

ORACLE["f3_relevant"] = with_("art") + f"SELECT id FROM art WHERE {_relevant(_topic_text())}"

ORACLE["a1_category_scores"] = with_("art") + f"SELECT id, {_category(_topic_text())} AS category FROM art"

ORACLE["s2_article_snapshot"] = with_("ing") + f"""SELECT id, url, url_hash, source, title,
  {_ts('published_at')} AS published_at, {_ts('fetched_at')} AS fetched_at, category FROM ing"""

ORACLE["a9_ingest_counts"] = with_("ing") + "SELECT source, count(*) AS n_items FROM ing GROUP BY source"

_STORE = """store AS (
  SELECT url, url_hash FROM art WHERE id % 3 = 0
  UNION ALL
  SELECT 'https://video.example.com/watch?v=v' || CAST(page_id AS VARCHAR), 'v' || CAST(page_id AS VARCHAR)
  FROM pages WHERE page_id % 4 = 0 AND page_id % 13 <> 0)"""

_INSERTED = f""", {_STORE},
ins AS (
  SELECT * FROM ing
  WHERE url NOT IN (SELECT url FROM store WHERE url IS NOT NULL)
    AND url_hash NOT IN (SELECT url_hash FROM store WHERE url_hash IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY source_ord, item_ord) = 1)
"""

ORACLE["s5_insert_if_absent"] = with_("ing").rstrip("\n") + _INSERTED + "SELECT id, url FROM ins"

ORACLE["a9_insert_counts"] = with_("ing").rstrip("\n") + _INSERTED + """SELECT
  (SELECT count(*) FROM ins) AS inserted, (SELECT count(*) FROM ing) - (SELECT count(*) FROM ins) AS skipped"""

ORACLE["s1_to_s2"] = with_("feed").rstrip("\n") + f""",
read AS (
  SELECT f.link AS url, sha256(f.link) AS url_hash, f.source, f.source_ord, f.item_ord,
    {{title}} AS title, {{summary}} AS summary,
    CASE WHEN f.id % 4 <> 3 THEN a.published_at END AS published_at
  FROM feed f JOIN art a ON a.id = f.id),
firsts AS (SELECT * FROM read WHERE url IS NOT NULL AND url <> ''
           QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY source_ord, item_ord) = 1)
SELECT url, url_hash, source, title, {_ts('published_at')} AS published_at, {_category(_topic_text())} AS category
FROM firsts
WHERE (published_at IS NULL OR published_at >= {AS_OF} - INTERVAL {C.MAX_AGE_HOURS} HOUR) AND {_relevant(_topic_text())}"""

ORACLE["s1_quarantine"] = """SELECT DISTINCT source, CAST(-1 AS BIGINT) AS feed, 'malformed XML' AS error FROM documents"""

# ---------------------------------------------------------------------------
# grouping
# ---------------------------------------------------------------------------

ORACLE["f4_lookback"] = with_("win") + f"SELECT id, {_ts('fetched_at')} AS fetched_at FROM win"

ORACLE["p3_title_tokens"] = with_("art") + f"""SELECT id, array_to_string(t, ' ') AS tokens, len(t) AS n
FROM (SELECT id, {_tokens('title')} AS t FROM art)"""

ORACLE["j3_similar_pairs"] = with_("pairs") + "SELECT id_a, id_b, n_a, n_b, n_inter FROM pairs"

ORACLE["g1_connected_components"] = with_("comp") + "SELECT id, story_group_id FROM comp"

ORACLE["g2_story_groups"] = with_("grp") + "SELECT id, story_group_id, is_duplicate FROM grp"

ORACLE["g3_attach"] = ORACLE["g2_story_groups"]

ORACLE["w2_group_anchor"] = with_("grp") + "SELECT story_group_id, id AS anchor_id FROM grp WHERE is_duplicate = 0"

ORACLE["a3_group_stats"] = with_("grp") + """SELECT story_group_id, count(*) AS members,
  count(DISTINCT source) AS n_sources, CAST(sum(is_duplicate) AS BIGINT) AS duplicates,
  count(DISTINCT source) > 1 AS multi_source
FROM grp GROUP BY story_group_id HAVING count(*) > 1"""

# ---------------------------------------------------------------------------
# ranking
# ---------------------------------------------------------------------------

ORACLE["a2_group_sizes"] = with_("sc") + "SELECT story_group_id, group_size FROM sizes"

ORACLE["m5_priority_score"] = with_("sc") + """SELECT id, recency, authority, bonus, boost,
  priority_score, is_multi_source FROM sc"""

ORACLE["o1_top_stories"] = with_("sc") + """SELECT id, title, source, category, story_group_id,
  priority_score, is_multi_source FROM sc ORDER BY priority_score DESC, id ASC LIMIT 8"""


# ---------------------------------------------------------------------------
# helpers for the later stages
# ---------------------------------------------------------------------------

# Java's (?U)\s set, spelled out for RE2 (whose \s is ASCII only).
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


ORACLE["s1_to_s2"] = ORACLE["s1_to_s2"].replace("{title}", _strip("f.title")).replace("{summary}", _strip("f.summary"))


def _clean(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')")


def _readable(x: str) -> str:
    t = f"coalesce({x}, '')"
    t = f"regexp_replace({t}, '<h[1-6][^>]*>', chr(10) || '### ', 'g')"
    t = f"regexp_replace({t}, '</h[1-6]>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<p[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '</p>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<br{WS}*/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(t)


def _word_count(x: str) -> str:
    return (f"len(list_filter(string_split_regex(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), "
            f"'{WS}+'), lambda w: w <> ''))")


def _decode(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g')"
    for ent, ch in C.DIGEST_ENTITIES:
        t = f"replace({t}, {_q(ent)}, {_q(ch)})"
    return _strip(t)


def _truncate(x: str, n: int = C.DIGEST_TRUNCATE) -> str:
    return (f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE "
            f"regexp_replace(substr({x}, 1, {n}), ' [^ ]*$', '') || '...' END)")


def _initcap1(x: str) -> str:
    """initcap of a single word"""
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def _domain(x: str) -> str:
    return (f"regexp_replace(lower(regexp_extract(coalesce({x}, ''), "
            f"'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '')")


def _headline_words(x: str) -> str:
    return f"list_slice(list_filter(string_split_regex(coalesce({x}, ''), '{WS}+'), lambda w: length(w) > 4), 1, 3)"


def _json_str(x: str) -> str:
    t = f"replace({x}, '\\', '\\\\')"
    t = f"replace({t}, '\"', '\\\"')"
    t = f"replace({t}, chr(9), '\\t')"
    t = f"replace({t}, chr(13), '\\r')"
    t = f"replace({t}, chr(10), '\\n')"
    return f"('\"' || {t} || '\"')"


def _pick_sql(values, idx):
    return _pick(values, idx)


_APPROVAL_CASE = "CASE " + " ".join(f"WHEN w = {_q(a)} THEN {_q(b)}" for a, b in C.APPROVAL_WORDS) + " END"
_FINAL = ", ".join(_q(s) for s in C.FINAL_STATUSES)

CTE["drafts_f"] = f"""drafts_f AS (
  SELECT d.doc_id AS id,
    CASE WHEN d.doc_id % 11 = 0 THEN CAST([] AS BIGINT[]) ELSE [d.doc_id, d.doc_id + 1] END AS raw_article_ids,
    split_part(d.text, chr(10), 1) AS headline,
    '<p>' || replace(d.text, chr(10), '</p><p>') || '</p>' AS body,
    {_pick(FIXTURE_CATEGORIES, 'd.doc_id % 8')} AS category,
    d.text AS seo_description,
    CASE d.doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN 'not json'
      WHEN 3 THEN '["' || split_part(p.p_name, ' ', 2) || '","' || split_part(p.p_name, ' ', 1) || '"]'
      WHEN 4 THEN '["zzz' || CAST(d.doc_id AS VARCHAR) || '","' || split_part(p.p_name, ' ', 1) || '"]'
      ELSE '["qqq","' || lower(p.p_type) || '","sss","' || split_part(p.p_name, ' ', 2) || '"]' END AS image_keywords,
    CASE WHEN d.doc_id % 7 = 0 THEN CAST(0 AS BIGINT) WHEN d.doc_id % 2 = 0 THEN d.doc_id + 10000 END AS wp_post_id,
    CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 4 = 1 THEN CAST(0 AS BIGINT) ELSE d.doc_id + 20000 END AS wp_image_id,
    {_pick(C.DRAFT_STATUSES, 'd.doc_id % 5')} AS status,
    {_minutes_before('(d.doc_id % 48) * 60')} AS created_at
  FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id)"""

CTE["sheet"] = """sheet AS (
  SELECT event_id AS row_ord,
    CASE WHEN event_id % 97 = 0 THEN 'x' || CAST(event_id AS VARCHAR) WHEN event_id % 101 = 0 THEN ''
         ELSE CAST(3 * (event_id % (SELECT max(doc_id) // 3 + 1 FROM documents)) AS VARCHAR) END AS draft_id,
    CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'REJECT ' WHEN 'click' THEN ' Edit'
         WHEN 'view' THEN '' ELSE 'maybe' END AS approval,
    props AS notes
  FROM events)"""

CTE["dec"] = f"""dec AS (
  SELECT row_ord, draft_id, w AS word, notes, {_APPROVAL_CASE} AS status FROM (
    SELECT row_ord, TRY_CAST(draft_id AS BIGINT) AS draft_id, upper({_strip("coalesce(approval, '')")}) AS w,
           {_strip("coalesce(notes, '')")} AS notes
    FROM sheet) WHERE draft_id IS NOT NULL)"""

CTE["fold"] = """fold0 AS (
  SELECT draft_id, coalesce(min(CASE WHEN status = 'rejected' THEN row_ord END), max(row_ord)) AS row_ord
  FROM dec WHERE status IS NOT NULL GROUP BY draft_id),
fold AS (SELECT f.draft_id, f.row_ord, d.status, d.notes FROM fold0 f JOIN dec d ON d.row_ord = f.row_ord)"""

CTE["lreq"] = f"""lreq AS (
  SELECT page_id + 2 AS row_ord, url,
    CASE WHEN page_id % 3 = 0 THEN 'note ' || CAST(page_id AS VARCHAR) ELSE '' END AS notes,
    {_pick(["", "Processed", "Error", "Error — timeout"], 'page_id % 4')} AS status,
    {_pick(["", "politics", " Opinion ", "weather", "Breaking News", "SPORTS"], 'page_id % 6')} AS category_override
  FROM pages),
pend AS (
  SELECT row_ord, {_strip("coalesce(url, '')")} AS url, {_strip("coalesce(notes, '')")} AS notes, status,
         {_strip("coalesce(category_override, '')")} AS category_override
  FROM lreq
  WHERE {_strip("coalesce(url, '')")} <> ''
    AND lower({_strip("coalesce(status, '')")}) NOT IN ({", ".join(_q(s) for s in C.REQUEST_DONE_STATUSES)}))"""

CTE["rules"] = f"""rules AS (
  SELECT DISTINCT domain, kind, label, match FROM (
    SELECT {_domain('url')} AS domain, 'twitter' AS kind, '' AS label, 'exact' AS match FROM pages WHERE page_id % 11 = 1
    UNION ALL
    SELECT {_domain('url')}, 'blocked_social', '', 'exact' FROM pages WHERE page_id % 11 = 2
    UNION ALL
    SELECT regexp_replace({_domain('url')}, '^(m|blog)\\.', ''), 'paywall',
           {_initcap1("split_part(regexp_replace(" + _domain('url') + ", '^(m|blog)\\.', ''), '.', 1)")}, 'suffix'
    FROM pages WHERE page_id % 11 = 3))"""

CTE["types"] = f"""dom AS (SELECT row_ord, {_domain('url')} AS domain FROM pend),
sfx AS (SELECT row_ord, domain, i, array_to_string(string_split(domain, '.')[i:], '.') AS s
        FROM (SELECT row_ord, domain, unnest(generate_series(1, len(string_split(domain, '.')))) AS i FROM dom)),
hits AS (
  SELECT x.row_ord, r.kind, r.label,
    row_number() OVER (PARTITION BY x.row_ord ORDER BY CASE r.kind WHEN 'twitter' THEN 1
      WHEN 'blocked_social' THEN 2 ELSE 3 END, r.domain, r.kind, r.label) AS rn
  FROM sfx x JOIN rules r ON r.domain = x.s AND (r.match = 'suffix' OR x.i = 1)),
types AS (SELECT d.row_ord, d.domain, coalesce(h.kind, 'article') AS url_type, coalesce(h.label, '') AS label
          FROM dom d LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h ON h.row_ord = d.row_ord)"""


def _override(raw: str) -> tuple[str, str]:
    shown = _strip(f"coalesce({raw}, '')")
    norm = f"lower({shown})"
    home = f"({norm} = '' OR {norm} IN ({', '.join(_q(x) for x in C.OVERRIDE_HOME_WORDS)}))"
    blocked = f"{norm} IN ({', '.join(_q(x) for x in C.OVERRIDE_BLOCKED)})"
    valid = f"{norm} IN ({', '.join(_q(x) for x in C.OVERRIDE_VALID)})"
    bh, bt = C.OVERRIDE_BLOCKED_MSG.split("{raw}")
    uh, ut = C.OVERRIDE_UNKNOWN_MSG.split("{raw}")
    key = f"(CASE WHEN {home} THEN NULL WHEN {blocked} THEN NULL WHEN NOT {valid} THEN NULL ELSE {norm} END)"
    err = (f"(CASE WHEN {home} THEN NULL WHEN {blocked} THEN {_q(bh)} || {shown} || {_q(bt)} "
           f"WHEN NOT {valid} THEN {_q(uh)} || {shown} || {_q(ut)} ELSE NULL END)")
    return key, err


_OV_KEY, _OV_ERR = _override("category_override")

CTE["outcome"] = f"""fres AS (
  SELECT url, CASE WHEN page_id % 10 = 7 THEN 403 WHEN page_id % 10 = 8 THEN 500 ELSE 200 END AS http_status,
         CASE WHEN page_id % 10 = 8 THEN 'HTTP 500 Server Error for url: ' || url END AS fetch_error
  FROM pages),
pg AS (SELECT url, CASE WHEN regexp_matches(html, '<(article|main|body)[\\s>/]') THEN NULL
                    ELSE 'No text container on the page.' END AS extract_error FROM pages),
outc AS (
  SELECT p.row_ord, p.url, t.url_type, {_OV_KEY} AS override_key,
    CASE WHEN {_OV_ERR} IS NOT NULL THEN {_OV_ERR}
         WHEN t.url_type = 'blocked_social' THEN 'Skipped — social post, needs a page link'
         WHEN t.url_type = 'paywall' THEN 'Skipped — subscribers only: ' || t.label
         WHEN t.url_type <> 'twitter' AND f.http_status IN (401, 403) THEN 'Skipped — access refused by the site'
         WHEN t.url_type <> 'twitter' AND f.fetch_error IS NOT NULL THEN 'Error — ' || substr(f.fetch_error, 1, 120)
         WHEN t.url_type = 'twitter' THEN 'Error — The embed holds no post text.'
         WHEN t.url_type <> 'twitter' AND coalesce(g.extract_error IS NOT NULL, true)
              THEN 'Error — ' || coalesce(g.extract_error, 'No text container on the page.')
         ELSE 'Processed' END AS status,
    CASE WHEN {_OV_ERR} IS NOT NULL THEN NULL
         WHEN t.url_type = 'blocked_social' THEN 'Social post: no page text to read; give the page it points to.'
         WHEN t.url_type = 'paywall' THEN t.label || ' shows its text to subscribers only; give an open page.'
         WHEN t.url_type <> 'twitter' AND f.http_status IN (401, 403)
              THEN 'The site refuses programs; give a page of another site.' END AS skip_reason
  FROM pend p JOIN types t ON t.row_ord = p.row_ord
  LEFT JOIN fres f ON f.url = p.url LEFT JOIN pg g ON g.url = p.url)"""

CTE["emb"] = f"""emb AS (
  SELECT 'https://x.com/u' || CAST(conv_id AS VARCHAR) || '/status/' || CAST(turn AS VARCHAR) AS url,
    CASE WHEN conv_id % 9 = 0 THEN '<blockquote>' || text || '</blockquote>'
         ELSE '<blockquote><p>' || text || '</p>&mdash; User ' || CAST(conv_id AS VARCHAR) || '</blockquote>' END AS html,
    CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'User ' || CAST(conv_id AS VARCHAR) END AS author_name,
    'https://x.example.com/u' || CAST(conv_id AS VARCHAR) || '/' AS author_url
  FROM conversations WHERE role = 'user')"""

CTE["resp"] = f"""resp0 AS (
  SELECT conv_id * 100 + turn AS request_id, conv_id,
    '{{"headline": ' || {_json_str("split_part(text, chr(10), 1)")}
    || ', "body": ' || {_json_str("'<p>' || text || '</p>'")}
    || ', "category": ' || {_json_str(_pick(FIXTURE_CATEGORIES, 'conv_id % 8'))}
    || ', "seo_description": ' || {_json_str("text")}
    || ', "image_keywords": [' || {_json_str("'kw' || CAST(conv_id AS VARCHAR)")} || ', ' || {_json_str("'news'")} || ']'
    || ', "source_attribution": ' || {_json_str("'src' || CAST(conv_id % 20 AS VARCHAR)")} || '}}' AS payload
  FROM conversations WHERE role = 'assistant'),
resp AS (
  SELECT request_id, CASE conv_id % 4 WHEN 0 THEN payload
    WHEN 1 THEN '```json' || chr(10) || payload || chr(10) || '```'
    WHEN 2 THEN 'Here is the draft:' || chr(10) || payload || chr(10) || 'Hope it helps.'
    ELSE replace(payload, '\\n', chr(10)) END AS raw
  FROM resp0),
ans0 AS (
  SELECT request_id, CASE WHEN starts_with(r, '```') THEN
      {_strip("CASE WHEN starts_with(split_part(r, '```', 2), 'json') THEN substr(split_part(r, '```', 2), 5) ELSE split_part(r, '```', 2) END")}
      ELSE r END AS r2
  FROM (SELECT request_id, {_strip("coalesce(raw, '')")} AS r FROM resp)),
ans1 AS (
  SELECT request_id, replace(CASE WHEN starts_with(r2, '{{') THEN r2
    WHEN instr(r2, '{{') > 0 AND instr(reverse(r2), '}}') > 0 AND length(r2) - instr(reverse(r2), '}}') + 1 > instr(r2, '{{')
    THEN substr(r2, instr(r2, '{{'), length(r2) - instr(reverse(r2), '}}') + 1 - instr(r2, '{{') + 1)
    ELSE r2 END, chr(10), '\\n') AS j
  FROM ans0),
ans AS (
  SELECT request_id, ok,
    CASE WHEN ok THEN json_extract_string(j, '$.headline') END AS headline,
    CASE WHEN ok THEN json_extract_string(j, '$.body') END AS body,
    CASE WHEN ok THEN json_extract_string(j, '$.category') END AS category,
    CASE WHEN ok THEN json_extract_string(j, '$.seo_description') END AS seo_description,
    CASE WHEN ok THEN json_extract_string(j, '$.source_attribution') END AS source_attribution,
    CASE WHEN ok THEN array_to_string(CAST(json_extract(j, '$.image_keywords') AS VARCHAR[]), ',') END AS image_keywords
  FROM (SELECT request_id, j, coalesce(json_valid(j) AND json_extract_string(j, '$.headline') IS NOT NULL
          AND json_extract_string(j, '$.body') IS NOT NULL AND json_extract_string(j, '$.category') IS NOT NULL,
          false) AS ok FROM ans1))"""

CTE["posts"] = f"""posts AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title_r,
    '<p>' || text || '&#8230;</p>' AS excerpt_r,
    'https://news.example.com/p/' || CAST(doc_id AS VARCHAR) AS link,
    [doc_id % 3, doc_id % 7] AS categories,
    CASE WHEN doc_id % 4 = 0 THEN 'draft' ELSE 'publish' END AS status,
    {_minutes_before('1440 - (doc_id * 37) % 2880')} AS date
  FROM documents)"""

_SECTIONS = " UNION ALL ".join(
    f"SELECT {_q(n)} AS section, [{', '.join(str(i) for i in ids)}]::BIGINT[] AS ids" for n, ids in C.DIGEST_SECTIONS)
_LIMITS = " ".join(f"WHEN {_q(n)} THEN {k}" for n, k in C.DIGEST_LIMITS)

CTE["dtop"] = f"""secs AS ({_SECTIONS}),
today AS (
  SELECT s.section, p.* FROM posts p JOIN secs s ON list_has_any(CAST(p.categories AS BIGINT[]), s.ids)
  WHERE p.status = 'publish' AND p.date > date_trunc('day', {AS_OF})),
dtop AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY date DESC, id DESC) AS rank FROM today)
  WHERE rank <= CASE section {_LIMITS} END)"""

CTE["vids"] = f"""vids0 AS (
  SELECT page_id, page_id % 3 AS channel,
    CASE WHEN page_id % 13 = 0 THEN NULL ELSE 'v' || CAST(page_id AS VARCHAR) END AS video_id,
    regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title,
    CASE WHEN page_id % 7 = 0 THEN '  ' || chr(10) || 'second line' ELSE 'Line one' || chr(10) || url END AS description,
    strftime({_minutes_before('(page_id % 72) * 60')}, '%Y-%m-%dT%H:%M:%SZ') AS published_at,
    CASE WHEN page_id % 5 = 0 THEN '' ELSE 'https://img.example.com/v/' || CAST(page_id AS VARCHAR) || '.jpg' END AS thumbnail
  FROM pages),
vids AS (
  SELECT video_id, channel, title, description, published_at, thumbnail,
    'https://video.example.com/embed/' || video_id AS embed_url,
    'https://video.example.com/watch?v=' || video_id AS watch_url,
    strptime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS pts
  FROM vids0 WHERE video_id IS NOT NULL),
vwin AS (SELECT * FROM vids WHERE pts > {AS_OF} - INTERVAL 24 HOUR),
vnew AS (SELECT * FROM vwin ORDER BY pts DESC, video_id ASC LIMIT 10)"""

CTE["cats"] = f"""cats AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, name, lower(replace(name, ' ', '-')) AS slug FROM (
    SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN {_pick(
        ["Breaking News", "Politics", "Business", "Sports", "Tech and Science",
         "Culture", "Regional News", "World", "Opinion", "Letters"], 'n_nationkey')}
      ELSE {_initcap1('n_name')} END AS name FROM nation)),
lk AS (
  SELECT key, id FROM (
    SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY pri ASC, id DESC) AS rn FROM (
      SELECT lower(name) AS key, id, 0 AS pri FROM cats UNION ALL SELECT lower(slug), id, 1 FROM cats))
  WHERE rn = 1)"""

_MAP_CASE = "CASE low " + " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in C.CATEGORY_MAP) + " ELSE low END"
_BLOCKED_SECTIONS = ", ".join(_q(x) for x in C.BLOCKED_SECTIONS)

CTE["routed"] = f"""unpub AS (SELECT * FROM drafts_f WHERE status = 'pending_editor' AND coalesce(wp_post_id, 0) = 0),
prim AS (SELECT CASE WHEN id <> 0 THEN id END AS pid FROM lk WHERE key = {_q(C.PRIMARY_SECTION)}),
routed0 AS (
  SELECT u.*, {_MAP_CASE} AS mapped FROM (SELECT *, lower(coalesce(category, '')) AS low FROM unpub) u),
routed AS (
  SELECT r.*, list_filter([(SELECT pid FROM prim),
      CASE WHEN r.mapped <> '' AND r.mapped NOT IN ({_BLOCKED_SECTIONS}) AND coalesce(l.id, 0) <> 0
            AND ((SELECT pid FROM prim) IS NULL OR l.id <> (SELECT pid FROM prim)) THEN l.id END],
      lambda v: v IS NOT NULL) AS category_ids
  FROM routed0 r LEFT JOIN lk l ON l.key = r.mapped)"""

_STORE_CTE = _STORE

DEPS.update({
    "drafts_f": [], "sheet": [], "dec": ["sheet"], "fold": ["dec"], "lreq": [], "rules": [],
    "types": ["lreq", "rules"], "outcome": ["types"], "emb": [], "resp": [], "posts": [], "dtop": ["posts"],
    "vids": [], "cats": [], "routed": ["drafts_f", "cats"],
})

# ---------------------------------------------------------------------------
# scalar queries
# ---------------------------------------------------------------------------

ORACLE["p1_url_hash"] = with_("art") + "SELECT id, url, sha256(url) AS url_hash FROM art"
ORACLE["p2_strip_ws"] = with_("feed") + f"SELECT id, {_strip('title')} AS title FROM feed"
ORACLE["p5_clean_text"] = with_("drafts_f") + f"SELECT id, {_clean('body')} AS text FROM drafts_f"
ORACLE["p6_html_to_readable"] = with_("drafts_f") + f"SELECT id, {_readable('body')} AS readable FROM drafts_f"
ORACLE["p7_word_count"] = with_("drafts_f") + f"SELECT id, {_word_count('body')} AS word_count FROM drafts_f"
ORACLE["p8_decode_entities"] = f"""SELECT page_id, {_decode("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title
FROM pages"""
ORACLE["p9_truncate_word"] = with_("posts") + f"SELECT id, {_truncate(_decode('excerpt_r'))} AS excerpt FROM posts"
ORACLE["p10_substr_caps"] = with_("drafts_f") + """SELECT id, substr(seo_description, 1, 90) AS desc90,
  substr(body, 1, 200) || '...' AS body_preview FROM drafts_f"""
ORACLE["p12_title_case"] = with_("lreq") + f"""SELECT row_ord, {_initcap1('k')} AS category FROM (
  SELECT row_ord, {_override('category_override')[0]} AS k FROM pend) WHERE k IS NOT NULL"""
ORACLE["p13_url_domain"] = f"SELECT page_id, {_domain('url')} AS domain FROM pages"
ORACLE["p15_headline_words"] = with_("drafts_f") + f"""SELECT id, array_to_string({_headline_words('headline')}, '|')
  AS words FROM drafts_f"""
ORACLE["d1_parse_published"] = with_("feed") + f"""SELECT id, published, {_ts('''coalesce(
    timezone('UTC', try_strptime(published, '%a, %d %b %Y %H:%M:%S %z')),
    try_strptime(regexp_replace(published, ' GMT$', ''), '%a, %d %b %Y %H:%M:%S'),
    try_strptime(published, '%Y-%m-%dT%H:%M:%SZ'))''')} AS published_at FROM feed"""
ORACLE["d3_age_hours"] = with_("art") + f"""SELECT id,
  round((epoch_us({AS_OF}) - epoch_us(published_at)) / 3.6e9, 3) AS age_hours FROM art"""
ORACLE["d4_minute_stamp"] = with_("drafts_f") + """SELECT id, coalesce(strftime(created_at, '%Y-%m-%d %H:%M'), '')
  AS created FROM drafts_f"""
ORACLE["d5_long_date"] = with_("posts") + f"""SELECT id, strftime(date, '%A, %d %B %Y') AS long_date,
  {_ts("date_trunc('day', date)")} AS day_start FROM posts"""

# ---------------------------------------------------------------------------
# filters
# ---------------------------------------------------------------------------

ORACLE["f5_ungrouped"] = with_("art") + "SELECT id FROM art WHERE id % 5 <> 0"
ORACLE["f6_anchors_only"] = with_("grp") + "SELECT id FROM grp WHERE is_duplicate = 0"
ORACLE["f7_needs_image"] = with_("drafts_f") + "SELECT id FROM drafts_f WHERE coalesce(wp_image_id, 0) = 0"
ORACLE["f8_unpublished"] = with_("drafts_f") + """SELECT id FROM drafts_f
WHERE status = 'pending_editor' AND coalesce(wp_post_id, 0) = 0"""
ORACLE["f10_by_status"] = with_("drafts_f") + """SELECT id, headline FROM drafts_f
WHERE status = 'pending_editor' AND coalesce(wp_post_id, 0) <> 0"""
ORACLE["f13_not_terminal"] = with_("drafts_f") + f"SELECT id, status FROM drafts_f WHERE status NOT IN ({_FINAL})"

# ---------------------------------------------------------------------------
# review
# ---------------------------------------------------------------------------

ORACLE["s10_review_sheet_read"] = with_("dec") + "SELECT row_ord, draft_id, word, status, notes FROM dec"
ORACLE["a8_approval_summary"] = with_("dec") + """SELECT
  count(*) FILTER (WHERE status = 'pending_publisher') AS approved,
  count(*) FILTER (WHERE status = 'rejected') AS rejected,
  count(*) FILTER (WHERE status = 'needs_edit') AS edited,
  count(*) FILTER (WHERE status IS NULL) AS skipped FROM dec"""
ORACLE["w3_approval_fold"] = with_("fold") + "SELECT draft_id, row_ord, status, notes FROM fold"
ORACLE["j12_apply_decisions"] = with_("drafts_f", "fold") + f"""SELECT d.id,
  CASE WHEN u THEN f.status ELSE d.status END AS status,
  CASE WHEN u THEN f.notes ELSE NULL END AS editor_notes, u AS updated
FROM (SELECT d.*, coalesce(f.status IS NOT NULL AND d.status NOT IN ({_FINAL}), false) AS u, f.draft_id AS fid
      FROM drafts_f d LEFT JOIN fold f ON f.draft_id = d.id) d
LEFT JOIN fold f ON f.draft_id = d.fid"""

_NEW = """newd AS (SELECT * FROM drafts_f WHERE status = 'pending_editor'
  AND id NOT IN (SELECT TRY_CAST(draft_id AS BIGINT) FROM sheet WHERE TRY_CAST(draft_id AS BIGINT) IS NOT NULL))"""

ORACLE["j2_not_in_sheet"] = with_("drafts_f", "sheet").rstrip("\n") + ",\n" + _NEW + "\nSELECT id FROM newd"

ORACLE["j8_review_rows"] = with_("art", "drafts_f", "sheet").rstrip("\n") + ",\n" + _NEW + f""",
mem AS (SELECT x.draft_id, x.aid, a.source, a.url
        FROM (SELECT id AS draft_id, unnest(raw_article_ids) AS aid FROM newd) x JOIN art a ON a.id = x.aid),
src AS (SELECT draft_id, array_to_string(list_sort(list_distinct(list(source))), ' + ') AS sources,
               string_agg(url, chr(10) ORDER BY aid) AS source_urls FROM mem GROUP BY draft_id)
SELECT n.id AS draft_id, coalesce(strftime(n.created_at, '%Y-%m-%d %H:%M'), '') AS date_generated,
  coalesce(n.category, '') AS category, coalesce(n.headline, '') AS headline,
  coalesce(n.seo_description, '') AS seo_description, {_readable('n.body')} AS body,
  {_word_count('n.body')} AS word_count, coalesce(s.sources, '') AS sources,
  coalesce(s.source_urls, '') AS source_urls, '' AS approval, '' AS editor_notes,
  CASE WHEN coalesce(n.wp_post_id, 0) <> 0 THEN CAST(n.wp_post_id AS VARCHAR) ELSE '' END AS wp_post_id
FROM newd n LEFT JOIN src s ON s.draft_id = n.id"""

ORACLE["j7_preview"] = with_("art", "drafts_f") + """, pd AS (SELECT * FROM drafts_f WHERE status = 'pending_editor'),
pm AS (SELECT x.draft_id, x.aid, a.source, a.url
       FROM (SELECT id AS draft_id, unnest(raw_article_ids) AS aid FROM pd) x JOIN art a ON a.id = x.aid)
SELECT p.id, p.headline, p.category, p.status,
  string_agg(pm.source, ' + ' ORDER BY pm.aid, pm.source, pm.url) AS sources,
  string_agg(pm.url, '|||' ORDER BY pm.aid, pm.source, pm.url) AS source_urls
FROM pd p LEFT JOIN pm ON pm.draft_id = p.id GROUP BY p.id, p.headline, p.category, p.status"""
ORACLE["j7_preview"] = ORACLE["j7_preview"].replace("\n, pd AS", ",\npd AS")

ORACLE["a6_status_counts"] = with_("drafts_f") + "SELECT status, count(*) AS n FROM drafts_f GROUP BY status"
ORACLE["a7_frequent_rejections"] = """SELECT reason, count(*) AS n FROM (
  SELECT 'reason ' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS reason
  FROM events WHERE event_type = 'error') GROUP BY reason HAVING count(*) >= 3"""
ORACLE["x12_notice_list"] = with_("drafts_f") + """, sel AS (SELECT * FROM drafts_f
  WHERE status IN ('pending_editor', 'pending_publisher') AND coalesce(wp_post_id, 0) <> 0)
SELECT status, count(*) OVER (PARTITION BY status) AS n_status, id, headline, category,
  substr(coalesce(seo_description, ''), 1, 90) AS description,
  'https://cms.example.com/edit?post=' || CAST(wp_post_id AS VARCHAR) AS link FROM sel"""
ORACLE["x12_notice_list"] = ORACLE["x12_notice_list"].replace("\n, sel AS", ",\nsel AS")

# ---------------------------------------------------------------------------
# drafting
# ---------------------------------------------------------------------------

_TOP = "top AS (SELECT * FROM sc ORDER BY priority_score DESC, id ASC LIMIT 8)"

ORACLE["j6_group_members"] = with_("sc").rstrip("\n") + ",\n" + _TOP + """
SELECT t.id AS story_id, g.id AS member_id FROM top t JOIN grp g ON g.story_group_id = t.story_group_id
WHERE t.is_multi_source"""

_content = _clean("coalesce(nullif(summary, ''), raw_content, '')")
_gcontent = _clean("coalesce(nullif(g.summary, ''), g.raw_content, '')")
ORACLE["x5_story_prompt"] = with_("sc").rstrip("\n") + ",\n" + _TOP + f""",
gm AS (
  SELECT t.id AS story_id, count(*) AS n,
    string_agg('[report by ' || coalesce(g.source, '') || '] ' || coalesce(g.title, '')
               || chr(10) || {_gcontent}, chr(10) || chr(10)
               ORDER BY length(g.raw_content) DESC NULLS LAST, g.id) AS blocks,
    string_agg(CAST(g.id AS VARCHAR), ',' ORDER BY length(g.raw_content) DESC NULLS LAST, g.id) AS ids
  FROM top t JOIN grp g ON g.story_group_id = t.story_group_id WHERE t.is_multi_source GROUP BY t.id)
SELECT t.id AS story_id,
  CASE WHEN coalesce(gm.n, 0) > 1 THEN gm.n ELSE 1 END AS n_sources,
  CASE WHEN coalesce(gm.n, 0) > 1 THEN gm.ids ELSE CAST(t.id AS VARCHAR) END AS raw_article_ids,
  CASE WHEN coalesce(gm.n, 0) > 1 THEN
    'TASK: merge ' || CAST(gm.n AS VARCHAR) || ' reports of one event into a single article; keep every fact once.'
    || chr(10) || chr(10) || gm.blocks
  ELSE 'TASK: write one article from one report.' || chr(10) || 'FROM: ' || coalesce(t.source, '')
    || chr(10) || 'TITLE: ' || coalesce(t.title, '') || chr(10) || 'MATERIAL:' || chr(10)
    || CASE WHEN length({_content.replace("summary", "t.summary").replace("raw_content", "t.raw_content")}) < 80
       THEN '(no text came with this report; the title is all there is)'
       ELSE {_content.replace("summary", "t.summary").replace("raw_content", "t.raw_content")} END
  END AS prompt
FROM top t LEFT JOIN gm ON gm.story_id = t.id"""

ORACLE["x3_parse_model_json"] = with_("resp") + """SELECT request_id, ok, headline, body, category,
  seo_description, source_attribution, image_keywords FROM ans"""
ORACLE["s12_draft_summary"] = with_("resp") + """SELECT request_id AS article_id, headline, category,
  seo_description, coalesce(image_keywords, '') AS image_keywords,
  coalesce(source_attribution, '') AS source_attribution,
  substr(coalesce(body, ''), 1, 200) || '...' AS body_preview FROM ans WHERE ok"""
ORACLE["s8_evolve_schema"] = with_("drafts_f", "resp") + """SELECT status, count(*) AS n,
  count(kw) AS with_keywords FROM (
  SELECT status, NULL AS kw FROM drafts_f
  UNION ALL SELECT 'pending_editor', image_keywords FROM ans WHERE ok) GROUP BY status"""
ORACLE["a10_stage_counts"] = with_("resp") + """SELECT count(*) FILTER (WHERE ok) AS drafted,
  count(*) AS requested FROM ans"""

# ---------------------------------------------------------------------------
# media
# ---------------------------------------------------------------------------

_KW = f"""kwd AS (
  SELECT id, CASE WHEN len(coalesce(p3, [])) > 0 THEN p3
         ELSE list_concat({_headline_words('headline')}, [coalesce(category, '')]) END AS keywords
  FROM (SELECT *, (CASE WHEN json_valid(image_keywords) AND json_type(image_keywords) = 'ARRAY'
                   THEN CAST(CAST(image_keywords AS JSON) AS VARCHAR[]) END)[1:3] AS p3 FROM drafts_f))"""

ORACLE["x1_keyword_cap"] = with_("drafts_f").rstrip("\n") + ",\n" + _KW + """
SELECT id, array_to_string(keywords, '|') AS keywords FROM kwd"""

ORACLE["j10_best_media"] = with_("drafts_f").rstrip("\n") + ",\n" + _KW + """,
need AS (SELECT k.* FROM kwd k JOIN drafts_f d ON d.id = k.id WHERE coalesce(d.wp_image_id, 0) = 0),
kx AS (SELECT id, lower(unnest(keywords[1:3])) AS tok, unnest(generate_series(1, len(keywords[1:3]))) AS pos FROM need),
mt AS (SELECT tok, min(p_partkey) AS media_id FROM (
         SELECT p_partkey, unnest(string_split_regex(lower(p_name), '\\s+')) AS tok FROM part) WHERE tok <> ''
       GROUP BY tok),
pt0 AS (SELECT p_partkey AS ord, 'ph' || CAST(p_partkey AS VARCHAR) AS pid,
          coalesce(CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(trunc(p_retailprice) AS BIGINT) END, 0) AS d,
          unnest(string_split_regex(lower(p_type || ' ' || replace(p_brand, '#', ' ')), '\\s+')) AS tok FROM part),
pt AS (SELECT tok, pid, d, ord FROM (
         SELECT *, row_number() OVER (PARTITION BY tok ORDER BY d DESC, ord ASC) AS rn FROM pt0 WHERE tok <> '')
       WHERE rn = 1),
j AS (SELECT kx.id, kx.pos, mt.media_id, pt.pid, pt.d, pt.ord FROM kx LEFT JOIN mt ON mt.tok = kx.tok
      LEFT JOIN pt ON pt.tok = kx.tok),
bm AS (SELECT id, media_id FROM (SELECT id, media_id, row_number() OVER (PARTITION BY id ORDER BY pos, media_id) rn
       FROM j WHERE media_id IS NOT NULL) WHERE rn = 1),
bp AS (SELECT id, pid FROM (SELECT id, pid, row_number() OVER (PARTITION BY id ORDER BY d DESC, ord ASC) rn
       FROM j WHERE pid IS NOT NULL) WHERE rn = 1)
SELECT n.id, CAST(bm.media_id AS VARCHAR) AS media_id, CASE WHEN bm.media_id IS NULL THEN bp.pid END AS photo_id,
  CASE WHEN bm.media_id IS NOT NULL THEN 'library' WHEN bp.pid IS NOT NULL THEN 'photo' ELSE 'none' END AS origin
FROM need n LEFT JOIN bm ON bm.id = n.id LEFT JOIN bp ON bp.id = n.id"""

# ---------------------------------------------------------------------------
# routing
# ---------------------------------------------------------------------------

ORACLE["x7_route_categories"] = with_("routed") + """SELECT id, category,
  array_to_string(category_ids, ',') AS category_ids FROM routed"""
ORACLE["x8_post_payload"] = with_("routed") + f"""SELECT id, headline AS title,
  coalesce(body, '') || chr(10) || chr(10) || '<p><em>Source(s): ' || coalesce(seo_description, '') || '</em></p>'
    AS content,
  'draft' AS status, coalesce(seo_description, '') AS excerpt,
  array_to_string(CASE WHEN list_contains(category_ids, {C.NEWSLETTER_SECTION_ID}) THEN category_ids
                  ELSE list_append(category_ids, {C.NEWSLETTER_SECTION_ID}) END, ',') AS categories,
  '{C.GENERATED_TAG_ID}' AS tags,
  CASE WHEN coalesce(wp_image_id, 0) <> 0 THEN CAST(wp_image_id AS VARCHAR) END AS featured_media
FROM routed"""

# ---------------------------------------------------------------------------
# link requests
# ---------------------------------------------------------------------------

ORACLE["f9_pending_requests"] = with_("lreq") + "SELECT row_ord, url, notes, category_override FROM pend"
ORACLE["m7_url_type"] = with_("types") + "SELECT row_ord, domain, url_type, label FROM types"
ORACLE["m8_validate_override"] = with_("lreq") + f"""SELECT row_ord, {_OV_KEY} AS override_key,
  {_OV_ERR} AS override_error FROM pend"""
ORACLE["m9_request_outcome"] = with_("outcome") + """SELECT row_ord, url, url_type, override_key, status,
  skip_reason FROM outc"""
ORACLE["x13_skip_notice"] = with_("outcome") + """SELECT row_ord, url, skip_reason AS reason FROM outc
WHERE skip_reason IS NOT NULL"""
ORACLE["x10_extract_embed_text"] = with_("emb") + f"""SELECT url,
  CASE WHEN coalesce(author_name, '') <> '' THEN author_name || ' (@'
       || reverse(split_part(reverse(regexp_replace(coalesce(author_url, ''), '/+$', '')), '/', 1)) || ')'
       ELSE '' END AS author_line,
  t AS text, CASE WHEN t = '' THEN 'The embed holds no post text.' END AS error
FROM (SELECT *, {_clean("regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1)")} AS t FROM emb)"""

# ---------------------------------------------------------------------------
# digest
# ---------------------------------------------------------------------------

ORACLE["f11_published_today"] = with_("dtop") + "SELECT section, id FROM today"
ORACLE["o2_digest_top"] = with_("dtop") + "SELECT section, id, rank FROM dtop"
ORACLE["x11_digest_text"] = with_("dtop") + f"""SELECT section, count(*) AS n_posts,
  CASE section WHEN 'morning' THEN 'Morning round-up' ELSE 'Evening reading' END || ', '
  || strftime({AS_OF}, '%A, %d %B %Y') || chr(10)
  || string_agg(CAST(rank AS VARCHAR) || ') ' || {_decode('title_r')} || chr(10) || '   '
                || {_truncate(_decode('excerpt_r'))} || chr(10) || '   <' || link || '>' || chr(10), '' ORDER BY rank)
  || '(end of digest)' AS text
FROM dtop GROUP BY section"""

# ---------------------------------------------------------------------------
# videos
# ---------------------------------------------------------------------------

ORACLE["s14_video_feed_read"] = with_("vids") + """SELECT video_id, channel, title, description, published_at,
  thumbnail, embed_url, watch_url FROM vids"""
ORACLE["f12_video_window"] = with_("vids") + "SELECT video_id FROM vwin"
ORACLE["o5_recent_videos"] = with_("vids") + "SELECT video_id, published_at FROM vnew"
ORACLE["j1_unsynced_videos"] = with_("vids", "art").rstrip("\n") + ",\n" + _STORE + """
SELECT video_id, watch_url FROM vnew WHERE watch_url NOT IN (SELECT url FROM store WHERE url IS NOT NULL)"""
ORACLE["w5_latest_video"] = with_("vids") + """SELECT channel, video_id FROM (
  SELECT channel, video_id, row_number() OVER (PARTITION BY channel ORDER BY pts DESC, video_id DESC) rn FROM vwin)
WHERE rn = 1"""
_fp = _strip("split_part(coalesce(description, ''), chr(10), 1)")
ORACLE["p14_video_post"] = with_("vids") + f"""SELECT video_id,
  CASE WHEN {_fp} <> '' THEN '<p>' || {_fp} || '</p>' || chr(10) || chr(10) ELSE '' END
  || '<figure class="video-embed"><iframe src="' || embed_url || '" title="' || title
  || '" allowfullscreen></iframe></figure>' || chr(10) || chr(10) || '<p><a href="' || watch_url
  || '" target="_blank" rel="noopener">Watch the video</a></p>' AS content,
  {_fp} AS first_paragraph FROM vids"""

# ---------------------------------------------------------------------------
# sources / sinks / streaming
# ---------------------------------------------------------------------------

ORACLE["s4_latest_snapshot"] = with_("ing") + f"SELECT id, url, category, {_ts('published_at')} AS published_at FROM ing"
ORACLE["s6_keyed_update"] = with_("sc") + """SELECT w.id, coalesce(s.priority_score, CAST(0 AS DOUBLE)) AS priority_score
FROM win w LEFT JOIN sc s ON s.id = w.id"""
ORACLE["s15_post_feed_read"] = with_("posts") + "SELECT id, title_r AS title, excerpt_r AS excerpt, link FROM posts"
ORACLE["t1_stream_ingest"] = with_("ing") + "SELECT id, url, source, category FROM ing"
ORACLE["t2_stream_dedup"] = with_("art") + "SELECT DISTINCT url_hash FROM art"
ORACLE["t5_stream_counts"] = with_("art") + f"""SELECT {_ts("date_trunc('day', fetched_at)")} AS window_start, source,
  count(*) AS n_items FROM art GROUP BY 1, 2"""

ORACLE["s1_feed_scan"] = with_("feed") + "SELECT item_ord AS id, source, link, title, published FROM feed"
ORACLE["s3_article_snapshot_read"] = with_("ing") + f"""SELECT id, url, category, {_ts('published_at')} AS published_at,
  {_ts('fetched_at')} AS fetched_at FROM ing"""

ORACLE["s9_review_queue_write"] = ("SELECT draft_id, headline, CAST(word_count AS VARCHAR) AS word_count, sources, "
                                   "source_urls, body, wp_post_id FROM (" + ORACLE["j8_review_rows"] + ")")

ORACLE["x5_prompt_blocks"] = with_("sc").rstrip("\n") + ",\n" + _TOP + f"""
SELECT t.id AS story_id, g.id AS member_id, CAST(length(g.raw_content) AS BIGINT) AS content_len,
  '[report by ' || coalesce(g.source, '') || '] ' || coalesce(g.title, '')
  || chr(10) || {_gcontent} AS block
FROM top t JOIN grp g ON g.story_group_id = t.story_group_id WHERE t.is_multi_source"""

_WIN = CTE["win"]
ORACLE["g3_incremental_groups"] = with_("grp").replace(
    _WIN, _WIN[:-1] + " AND id % 5 <> 0)") + "SELECT id, story_group_id, is_duplicate FROM grp"

# one key per remaining inventory ID
ORACLE["m1_recency_score"] = with_("sc") + "SELECT id, recency FROM sc"
ORACLE["m2_authority_score"] = with_("sc") + "SELECT id, source, authority FROM sc"
ORACLE["m3_cross_source_bonus"] = with_("sc") + "SELECT id, group_size, bonus FROM sc"
ORACLE["m4_category_boost"] = with_("sc") + "SELECT id, category, boost FROM sc"
ORACLE["m6_multi_source_flag"] = with_("sc") + "SELECT id, is_multi_source FROM sc"
ORACLE["m10_draft_category"] = with_("lreq") + f"""SELECT row_ord,
  coalesce({_initcap1(_override('category_override')[0])}, {_pick(FIXTURE_CATEGORIES, 'row_ord % 8')}) AS category
FROM pend"""
ORACLE["p4_jaccard"] = with_("pairs") + """SELECT id_a, id_b,
  round(n_inter / (n_a + n_b - n_inter), 6) AS jaccard FROM pairs"""
ORACLE["p11_first_paragraph"] = with_("vids") + f"SELECT video_id, {_fp} AS first_paragraph FROM vids"
ORACLE["d6_day_start"] = with_("posts") + f"SELECT id, {_ts("date_trunc('day', date)")} AS day_start FROM posts"
ORACLE["o3_queue_order"] = with_("drafts_f") + """SELECT id, headline FROM drafts_f WHERE status = 'pending_editor'
ORDER BY id DESC"""
ORACLE["x2_dedupe_ids"] = "SELECT story_id, raw_article_ids FROM (" + ORACLE["x5_story_prompt"] + ")"
ORACLE["a4_distinct_concat"] = "SELECT draft_id, sources FROM (" + ORACLE["j8_review_rows"] + ")"
ORACLE["a5_group_concat"] = "SELECT id, sources, source_urls FROM (" + ORACLE["j7_preview"] + ")"
ORACLE["a11_max_downloads"] = "SELECT id, photo_id FROM (" + ORACLE["j10_best_media"] + ") WHERE origin = 'photo'"
ORACLE["s7_draft_append"] = with_("resp") + f"""SELECT request_id AS id, headline, category, 'pending_editor' AS status,
  {_ts(AS_OF)} AS created_at, coalesce(image_keywords, '') AS image_keywords FROM ans WHERE ok"""
ORACLE["s13_html_pages_read"] = "SELECT url, CAST(length(html) AS BIGINT) AS n_chars FROM pages"
ORACLE["t3_stream_upsert_replay"] = with_("ing") + "SELECT id, url, category FROM ing"
ORACLE["t4_late_drop"] = ORACLE["f2_fresh"]

ORACLE["j4_group_size_lookup"] = with_("sc") + "SELECT id, story_group_id, group_size FROM sc"
ORACLE["j5_authority_lookup"] = with_("sc") + "SELECT DISTINCT source, authority FROM sc"
ORACLE["j9_category_lookup"] = with_("drafts_f", "cats") + f""",
unpub AS (SELECT * FROM drafts_f WHERE status = 'pending_editor' AND coalesce(wp_post_id, 0) = 0),
m AS (SELECT id, category, {_MAP_CASE} AS mapped_name FROM (SELECT *, lower(coalesce(category, '')) AS low FROM unpub))
SELECT m.id, m.category, m.mapped_name, CAST(l.id AS VARCHAR) AS topic_id FROM m LEFT JOIN lk l ON l.key = m.mapped_name"""
ORACLE["j9_category_lookup"] = ORACLE["j9_category_lookup"].replace("\n,\nunpub AS", ",\nunpub AS")
_ALL_SECTION_IDS = ", ".join(str(i) for i in sorted({i for _, ids in C.DIGEST_SECTIONS for i in ids}))
ORACLE["j11_section_overlap"] = with_("posts") + f"""SELECT id FROM posts
WHERE list_has_any(CAST(categories AS BIGINT[]), [{_ALL_SECTION_IDS}]::BIGINT[])"""
ORACLE["j13_domain_rule_lookup"] = with_("types") + "SELECT row_ord, url_type, label FROM types WHERE url_type <> 'article'"
ORACLE["w4_best_media"] = "SELECT id, media_id FROM (" + ORACLE["j10_best_media"] + ") WHERE origin = 'library'"
ORACLE["o4_longest_first"] = "SELECT story_id, member_id, content_len FROM (" + ORACLE["x5_prompt_blocks"] + ")"
ORACLE["x4_repair_json_newlines"] = with_("resp") + """SELECT a.request_id, json_extract_string(a.j, '$.headline') AS headline
FROM ans1 a JOIN ans0 b ON a.request_id = b.request_id
WHERE NOT coalesce(json_valid(CASE WHEN starts_with(b.r2, '{') THEN b.r2
    WHEN instr(b.r2, '{') > 0 AND instr(reverse(b.r2), '}') > 0 AND length(b.r2) - instr(reverse(b.r2), '}') + 1 > instr(b.r2, '{')
    THEN substr(b.r2, instr(b.r2, '{'), length(b.r2) - instr(reverse(b.r2), '}') + 1 - instr(b.r2, '{') + 1)
    ELSE b.r2 END), false)
  AND json_valid(a.j)"""
ORACLE["s11_link_sheet_read"] = with_("lreq") + "SELECT row_ord, url, notes, category_override FROM pend"
