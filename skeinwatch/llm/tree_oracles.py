"""DuckDB SQL for the Merkle manifest, the shards and the prefix trie, from their definitions."""

from __future__ import annotations

#: CRC-32 of each half byte alone (the reflected polynomial 0xEDB88320), fixed values.
_NIBBLES = (
    0, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
)


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, half byte by half byte, the lower one first."""
    halves = rf"string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\2\1', 'g'), '')"
    digits = f"list_transform(list_filter({halves}, lambda h: h <> ''), lambda h: strpos('0123456789ABCDEF', h)::BIGINT - 1)"
    table = f"CAST([{', '.join(map(str, _NIBBLES))}] AS BIGINT[])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, x: xor(c >> 4, {table}[(xor(c, x) & 15) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

_OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS g, sha256({_LEAF} || {_field("text")}) AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN sha256({_LEAF} || {_field("replace(text, chr(10), '')")}) END AS other
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n FROM d
), up(g, level, n, h) AS (
  SELECT g, 0, n, leaf FROM leaves
  UNION ALL
  SELECT g, level + 1, n // 3, sha256(string_agg(h, '' ORDER BY n)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM up)
  WHERE c > 1 GROUP BY g, level, n // 3
), sub AS (
  SELECT g, arg_max(h, level) AS subroot, max(level) AS top, row_number() OVER (ORDER BY g) - 1 AS n FROM up GROUP BY g
), over_(level, n, h) AS (
  SELECT 0, n, subroot FROM sub
  UNION ALL
  SELECT level + 1, n // 3, sha256(string_agg(h, '' ORDER BY n)) FROM (SELECT *, count(*) OVER () AS c FROM over_)
  WHERE c > 1 GROUP BY level, n // 3
), every AS (
  SELECT g, level, n, h FROM up UNION ALL SELECT '', level, n, h FROM over_
), seg AS (
  SELECT a.g, a.level, a.n, coalesce(string_agg(b.h, '' ORDER BY b.n) FILTER (WHERE b.n < a.n), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.n) FILTER (WHERE b.n > a.n), '') AS r
  FROM every a JOIN every b ON a.g = b.g AND a.level = b.level AND a.n // 3 = b.n // 3
  WHERE a.level < (SELECT max(level) FROM every e WHERE e.g = a.g)
  GROUP BY a.g, a.level, a.n
), way AS (
  SELECT x.g, x.n, seg.level AS step, l, r FROM leaves x JOIN seg ON seg.g = x.g AND seg.n = x.n // (3 ** seg.level)::BIGINT
  UNION ALL
  SELECT x.g, x.n, sub.top + seg.level, l, r
  FROM leaves x JOIN sub ON sub.g = x.g JOIN seg ON seg.g = '' AND seg.n = sub.n // (3 ** seg.level)::BIGINT
), fold(g, n, step, h) AS (
  SELECT g, n, 0, coalesce(other, leaf) FROM leaves
  UNION ALL
  SELECT f.g, f.n, f.step + 1, sha256(w.l || f.h || w.r) FROM fold f JOIN way w ON w.g = f.g AND w.n = f.n AND w.step = f.step
), ends AS (
  SELECT g, n, arg_max(h, step) AS folded_root FROM fold GROUP BY g, n
), proofs AS (
  SELECT g, n, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM way GROUP BY g, n
), root AS (
  SELECT arg_max(h, level) AS root FROM over_
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN sub USING (g) JOIN ends ON ends.g = leaves.g AND ends.n = leaves.n
LEFT JOIN proofs ON proofs.g = leaves.g AND proofs.n = leaves.n, root
"""

_OP12 = f"""
WITH RECURSIVE keys AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5({_field("doc_id")}), 1, 15))::BIGINT::HUGEINT AS k FROM documents
), jumps(doc_id, k, b, j) AS (
  SELECT doc_id, k, -1::BIGINT, 0::BIGINT FROM keys
  UNION ALL
  SELECT doc_id, nk, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS nk FROM jumps WHERE j < 17)
), shards AS (
  SELECT doc_id, max(b) FILTER (WHERE b < 16)::INTEGER AS shard, max(b) FILTER (WHERE b < 17)::INTEGER AS grown_shard FROM jumps GROUP BY doc_id
), rows_ AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents
)
SELECT r.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY r.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM rows_ r JOIN shards s ON r.doc_id IS NOT DISTINCT FROM s.doc_id
"""

_OP13 = rf"""
WITH t AS (
  SELECT conv_id::BIGINT AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL
), c0 AS (
  SELECT c, count(*) AS own, {_crc32("c::VARCHAR")} % 4 AS h, c - ((c % 20) + 20) % 20 AS base FROM t GROUP BY c
), convs AS (
  SELECT a.c, a.h, a.base, a.own, least(a.h, coalesce(b.own, 0)) AS led FROM c0 a LEFT JOIN c0 b ON b.c = a.base
), seq AS (
  SELECT v.c, t.n + 1 AS d, t.h, t.words FROM convs v JOIN t ON t.c = v.base AND t.n < v.h
  UNION ALL
  SELECT v.c, t.n - v.h + v.led + 1, t.h, t.words FROM convs v JOIN t ON t.c = v.c AND t.n >= v.h
), pre AS (
  SELECT c, 0 AS d, '' AS p, 0 AS words FROM convs
  UNION ALL
  SELECT c, d, string_agg(h, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), words FROM seq
), labelled AS (
  SELECT *, min(c) OVER (PARTITION BY d, p) AS own, max(d) OVER (PARTITION BY c) AS len FROM pre
), ends AS (
  SELECT own, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM labelled WHERE d = len GROUP BY own, d
), nodes AS (
  SELECT own AS conv_id, d, count(*) AS n_convs, any_value(words) AS words FROM labelled GROUP BY own, d
), child AS (
  SELECT x.conv_id, x.d, l.own AS parent, x.n_convs, x.words FROM nodes x LEFT JOIN labelled l ON l.c = x.conv_id AND l.d = x.d - 1
), kids AS (
  SELECT parent, d - 1 AS d, count(*) AS n FROM child WHERE d > 0 GROUP BY ALL
), whole AS (
  SELECT x.*, coalesce(k.n, 0) AS n_children FROM child x LEFT JOIN kids k ON k.parent = x.conv_id AND k.d = x.d
), sums AS (
  SELECT l.own AS conv_id, l.d, sum((w.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((w.n_convs - 1) * w.words)::BIGINT AS saved_tokens
  FROM whole w JOIN labelled l ON l.c = w.conv_id AND l.d <= w.d GROUP BY l.own, l.d
), places AS (
  SELECT w.conv_id, w.d, string_agg(lpad(l.own::VARCHAR, 20, '0'), '' ORDER BY l.d) AS way
  FROM whole w JOIN labelled l ON l.c = w.conv_id AND l.d <= w.d GROUP BY w.conv_id, w.d
), ranked AS (
  SELECT conv_id, d, row_number() OVER (ORDER BY way) - 1 AS before FROM places
)
SELECT w.conv_id, w.d::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256, (2 * before - w.d)::BIGINT AS enters
FROM whole w JOIN sums s ON s.conv_id = w.conv_id AND s.d = w.d JOIN ranked r ON r.conv_id = w.conv_id AND r.d = w.d
LEFT JOIN ends e ON e.own = w.conv_id AND e.d = w.d
"""

ORACLE = {"op11_merkle_manifest": _OP11, "op12_jump_shards": _OP12, "op13_prefix_trie": _OP13}
