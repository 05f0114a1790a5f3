"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_OP5 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_inner_product(q.e, r.e)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
)


def _kind(i: int, name: str, regex: str, group: int, least: int) -> str:
    r = regex.replace("'", "''")
    return f"""
SELECT doc_id, {i} AS k, '{name}' AS name, gap_sum + size_sum - size AS a, gap_sum + size_sum AS b FROM (
  SELECT doc_id, size, held, sum(gap) OVER w AS gap_sum, sum(size) OVER w AS size_sum FROM (
    SELECT doc_id, n, length(pieces[n]) AS gap, length(hits[n]) AS size, length(held[n]) AS held FROM (
      SELECT doc_id, string_split_regex(text, '{r}') AS pieces, regexp_extract_all(text, '{r}', 0) AS hits,
             regexp_extract_all(text, '{r}', {group}) AS held FROM docs
    ), unnest(range(1, len(hits) + 1)) AS u(n)
  ) WINDOW w AS (PARTITION BY doc_id ORDER BY n)
) WHERE held >= {least}"""


_OP6 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(_kind(i, *x) for i, x in enumerate(_KINDS))}),
listed AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(name || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k) FILTER (k < 3) AS base,
         string_agg(name || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k) AS spans
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed l ON d.doc_id IS NOT DISTINCT FROM l.doc_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = (
    ("example.org", "/en/1", "block"),
    ("example.org", "/es/", "block"),
    ("com", "/de/", "block"),
    ("com", "/fr/", "allow"),
    ("org", "/", "allow"),
)


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _case(host: str, path: str, what: int) -> str:
    fits = " ".join(
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[what]}'" for h,
        p,
        v in _RULES
    )
    return f"CASE {fits} END"


def _node(url: str) -> str:
    query = f"array_to_string(list_filter(string_split(coalesce(regexp_extract({url}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), ''), '&'), lambda p: NOT starts_with(p, 'utm_') AND p <> ''), '&')"
    return f"""CASE WHEN {_host(url)} <> '' THEN regexp_replace({_host(url)}, '^www\\.', '') || regexp_replace({_path(url)}, '/$', '') || CASE
  WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"""


_ABSOLUTE = """CASE WHEN link = '' THEN NULL WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
  WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || link
  WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*', 0) || link
  ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*(?:[^?#]*/)?', 0)
    || CASE WHEN ends_with(regexp_extract(url, '(?s)^.*?://[^/?#]*(?:[^?#]*/)?', 0), '/') THEN '' ELSE '/' END || link END"""

def _judged(url: str) -> str:
    return f"{_node(url)} AS node, {_case(_host(url), _path(url), 1)} AS v"


def _op7(moved: str = "") -> str:
    """moved: SQL of more links (url, target), if any."""
    return f"""
WITH RECURSIVE tags AS (
  SELECT url, regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0) AS c,
         regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0) AS m
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), links AS (
  SELECT url, regexp_extract(c, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS link FROM tags
  UNION ALL SELECT url, regexp_extract(m, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM tags
), ends AS (SELECT url, {_ABSOLUTE} AS target FROM links WHERE link <> ''{moved}),
edges AS (SELECT {_node("url")} AS a, {_node("target")} AS b FROM ends),
two_way AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
every AS (SELECT {_node("url")} AS node FROM pages UNION SELECT a FROM two_way),
reach AS (SELECT node, node AS other FROM every WHERE node IS NOT NULL UNION SELECT r.node, e.b FROM reach r JOIN two_way e ON r.other = e.a),
verdicts AS (
  SELECT {_judged("url")} FROM pages UNION ALL SELECT {_judged("target")} FROM ends
), classes AS (
  SELECT r.node, bool_or(v.v = 'allow') AS allowed, bool_or(v.v = 'block') AS blocked
  FROM reach r JOIN verdicts v ON v.node = r.other WHERE v.v IS NOT NULL GROUP BY r.node
), aliased AS (SELECT node FROM classes WHERE blocked AND NOT allowed),
seen AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS node FROM pages),
ruled AS (SELECT *, {_case("host", "path", 0)} AS rule, {_case("host", "path", 1)} AS own FROM seen)
SELECT page_id, host, path, rule, CASE WHEN own IS NOT NULL THEN own WHEN a.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN a.node IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM ruled LEFT JOIN aliased a ON ruled.node = a.node
"""

_TAILS = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)"

_OP10 = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 13 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*){_TAILS}', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*){_TAILS}', '\1\2\\\3', 'g')) + 11 AS chars FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLE = {
    "op5_exact_topk": _OP5,
    "op6_secret_scan": _OP6,
    "op7_url_filter": _op7(),
    "url_filter_redirects": _op7(" UNION ALL SELECT url, replace(url, '/en/', '/de/') FROM pages WHERE page_id % 3 = 0 AND url LIKE '%/en/%'"),
     "op10_chat_paths": _OP10,
}
