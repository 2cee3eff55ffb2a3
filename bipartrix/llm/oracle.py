"""SQL for DuckDB of the queries that SQL can express; what it reads is the whole tables, as the queries do."""

from __future__ import annotations

#: CRC-32 by half bytes over the hex digits of a text: a list of 16 table values, then one step for each digit, low half first.
CRC = """tbl AS (SELECT list_transform(range(16), lambda i: list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0]::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) t),
hexed AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') h FROM documents),
halves AS (SELECT doc_id, size, CASE WHEN len(h) < 2 THEN []::UBIGINT[] ELSE list_transform(range(len(h)), lambda i: (instr('0123456789ABCDEF', h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1)::UBIGINT) END h FROM hexed),
sized AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::UBIGINT, h), lambda c, b: xor(c >> 4, t[((xor(c, b) & 15) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM halves, tbl)"""

OP5 = f"""WITH {CRC},
sums AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS nth FROM sized),
placed AS (SELECT *, least(23, ((2 * before + size) * 24) // (2 * total))::INT AS shard FROM sums)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM placed"""

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _rule(i: int) -> str:
    """CASE over the rules, longest first; i picks the rule's name or its verdict."""
    lines = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p, v)[i]}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    return f"CASE {' '.join(lines)} END"


LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Alias links are absolute ones here: ``link rel=canonical`` and ``meta refresh``; classes by a recursive walk.
OP9 = f"""WITH RECURSIVE base AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u, {LOW.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(html, '(?i)<link\\b[^>]*canonical[^>]*\\bhref=["'']?([^"''\\s>]+)', 1) AS canonical, regexp_extract(html, '(?i)<meta\\b[^>]*refresh[^>]*\\burl=["'']?([^"''\\s>]+)', 1) AS target FROM pages),
links AS (SELECT u, canonical v FROM base WHERE canonical <> '' UNION SELECT u, target FROM base WHERE target <> ''),
sides AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u, v FROM sides UNION SELECT r.u, b.v FROM reach r JOIN sides b ON b.u = r.v),
own AS (SELECT *, {_rule(0)} AS rule, {_rule(1)} AS decided FROM base),
said AS (SELECT r.u, bool_or(o.decided = 'allow') AS allowed, bool_or(o.decided = 'block') AS blocked FROM reach r JOIN own o ON o.u = r.v GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM own LEFT JOIN said USING (u)"""

#: Base32 of a SHA-1: five hex digits are four letters.
B32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(coalesce(html, '')), (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '')"

OP1 = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, {B32} AS digest FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""



def _field(c: str) -> str:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: CRC-32 of the digits of doc_id, bit by bit.
CRC_OF_ID = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * len(doc_id::VARCHAR)), lambda i: ((ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1)::UBIGINT)), lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END), 4294967295::UBIGINT)"


def _tree(name: str, nodes: str) -> str:
    """Levels of the trees over ``nodes`` (g, pos, n, h), and the walk from each node (id, start) up: its siblings joined, what it folds to, the root."""
    return f"""{name}_level AS (SELECT 0 AS l, g, pos, n, h FROM {nodes} UNION ALL
  SELECT l + 1, g, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}_level WHERE n > 1 GROUP BY l, g, pos // 2),
{name}_walk AS (SELECT 0 AS l, id, g, pos, n, '' AS proof, start AS fold FROM {nodes} UNION ALL
  SELECT w.l + 1, w.id, w.g, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''), sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.fold ELSE w.fold || coalesce(s.h, '') END)
  FROM {name}_walk w LEFT JOIN {name}_level s ON s.l = w.l AND s.g = w.g AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
{name}_root AS (SELECT g, h AS root FROM {name}_level WHERE n = 1)"""


#: The outer walk starts from what each row's inner walk folds to.
OP13 = f"""WITH RECURSIVE leaves AS (SELECT row_number() OVER () AS id, doc_id, coalesce('1' || lang, '0') AS g, {_leaf("n_chars")} AS h, CASE WHEN {CRC_OF_ID} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS bad FROM documents),
nodes AS (SELECT *, coalesce(bad, h) AS start, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_tree("inner", "nodes")},
groups AS (SELECT '' AS g, g AS id, root AS h, root AS start, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM inner_root),
{_tree("outer", "groups")},
rows_up AS (SELECT w.id, g.g, g.pos, g.n, w.fold AS start FROM inner_walk w JOIN (SELECT id AS own, '' AS g, pos, n FROM groups) g ON g.own = w.g WHERE w.n = 1),
fold AS (SELECT 0 AS l, id, pos, n, start AS h FROM rows_up UNION ALL
  SELECT f.l + 1, f.id, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END) FROM fold f LEFT JOIN outer_level s ON s.l = f.l AND s.pos = xor(f.pos, 1) WHERE f.n > 1)
SELECT v.doc_id, v.h AS leaf, i.root AS subroot, o.root AS root, sha256(w.proof || u.proof) AS proof_sha256, f.h AS folded_root, f.h = o.root AS verified
FROM nodes v JOIN inner_root i USING (g) JOIN inner_walk w ON w.id = v.id AND w.n = 1 JOIN outer_walk u ON u.id = v.g AND u.n = 1 JOIN fold f ON f.id = v.id AND f.n = 1 CROSS JOIN outer_root o"""

SQL = {"op1_warc_chunks": OP1, "op5_prefix_sum_shards": OP5, "op9_redirect_equivalence": OP9, "op13_merkle_manifest": OP13}
