"""DuckDB SQL for the queries that SQL can express in full.

The others have none: quality, licences and sharding settle by methods of their own over the whole table, and personal
data, secrets, BPE and page extraction are trained or coded; they are tested against brute force instead. What the
contracts fix of quality, licences, personal data and secrets has queries of its own, with SQL.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Smallest id reachable over pairs (a, b), given in both directions, for every row of `nodes`.
_REACH = "reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a), components AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"



def _found(kind: int, name: str, pattern: str, keep: str) -> str:
    """Spans of a pattern as (doc_id, s, kind, e): matches m and what stands between them give the places."""
    q = pattern.replace("'", "''")
    return (
        f"x{kind} AS (SELECT doc_id, regexp_extract_all(t, '{q}') AS m, string_split_regex(t, '{q}') AS b FROM d WHERE regexp_matches(t, '{q}')), "
        f"y{kind} AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS v, m, b FROM x{kind}), "
        f"z{kind} AS (SELECT doc_id, '{name}' AS name, {kind} AS kind, v, list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS s FROM y{kind}), "
        f"f{kind} AS (SELECT doc_id, name, kind, s, s + length(v) AS e FROM z{kind} WHERE {keep})"
    )


def _spans_sql(kinds: list[tuple[str, str, str]]) -> str:
    """Counts of each kind and the digest of all spans in order."""
    parts = [_found(i, *k) for i, k in enumerate(kinds)]
    both = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(len(kinds)))
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k[0]}" for i, k in enumerate(kinds))
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)}, f AS ({both}), "
        f"g AS (SELECT doc_id, {counts}, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS j FROM f GROUP BY 1) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{k[0]}, 0)::BIGINT AS n_{k[0]}' for k in kinds)}, sha256(coalesce(j, '')) AS base_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id"
    )


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CASE WHEN i % 2 = 1 THEN {_DIGITS}[length({_DIGITS}) - i]::INT + 1 ELSE 1 END] + CASE WHEN i % 2 = 0 THEN {_DIGITS}[length({_DIGITS}) - i]::INT ELSE 0 END)) % 10 = 0"

SQL: dict[str, str] = {
    "base_quality": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' ')))) AS g FROM w WHERE len(w) >= 8),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
s AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY 1),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(s.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN s ON s.doc_id = w.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c""",
    "base_licenses": """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS m, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS a, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g FROM w)
SELECT doc_id, n_words, (len(m) + len(a) + len(g))::BIGINT AS n_base, list_min(m || a || g)::BIGINT AS first_word, list_max(m || a || g)::BIGINT AS last_word, concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM p""",
    "base_pii": _spans_sql(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: coalesce(try_cast(x AS BIGINT) > 255, true))) = 0"),
            ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
        ]
    ),
    "base_secrets": _spans_sql(
        [
            ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""length(regexp_extract(v, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 6"""),
            ("access", "AKIA[A-Z0-9]+", "length(v) >= 20"),
            ("hex", "[0-9a-f]+", "length(v) >= 24"),
        ]
    ),
    "op1_mixing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS d FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT])::DOUBLE AS weight, 2::DOUBLE * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
  sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM w),
l AS (SELECT max((1.5::DOUBLE * (SELECT sum(source_size) FROM s) - caps_before) / weight_left) AS level FROM c),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM c, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY t.source ORDER BY d.d, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (whole + CAST(2 * before + size < 2 * (target - whole * source_size) AND whole < 2 AS INT))::INT AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM k""",
    "op2_embeddings": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACH}, n AS (SELECT a AS id, count(*) AS n FROM pairs GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.id = component_id AS kept FROM components c LEFT JOIN n USING (id)""",
    "op7_minhash": f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM common JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
{_REACH}
SELECT c.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.id = component_id AS kept FROM components c LEFT JOIN n USING (id)""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS leader FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM leader THEN leader END AS refers_to FROM g""",
    "op12_panes": """
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(0, 256)) AS i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
r AS (SELECT click_id, min(row(coalesce(arrived_at, ts), ts, kind, value)) AS r FROM clicks WHERE ts IS NOT NULL AND click_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT click_id, row(coalesce(arrived_at, ts), ts, kind, value) FROM clicks WHERE ts IS NOT NULL AND click_id IS NULL),
c AS (SELECT click_id, coalesce(r[3], 'none') AS kind, CASE WHEN r[4] IS NULL OR NOT isfinite(r[4]) THEN 0 ELSE floor(100 * r[4] + 0.5)::BIGINT END AS cents, epoch_us(r[2]) AS ts, epoch_us(r[1]::DATE) // 86400000000 AS d,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(click_id::VARCHAR) + 1), lambda j: ord(substr(click_id::VARCHAR, j, 1))::BIGINT)), lambda x, y: xor(t[xor(x, y) % 256 + 1], x // 256))) AS crc FROM r, tab),
e AS (SELECT click_id, kind, cents, least(7, (d % 8 + 8) % 8 + greatest(0, coalesce(crc, 0) % 30 - 23)) AS batch, ts - (d - (d % 8 + 8) % 8) * 86400000000 AS event FROM c),
h AS (SELECT *, (event - (event % 3600000000 + 3600000000) % 3600000000) // 3600000000 AS hour FROM e),
b AS (SELECT k AS batch, (SELECT max(event) FROM h WHERE h.batch < k) AS w FROM (SELECT unnest(range(0, 8)) AS k)),
p AS (SELECT kind, hour, coalesce((SELECT min(batch) FROM b WHERE w >= (hour + 7) * 3600000000), 99) AS due, coalesce((SELECT min(batch) FROM b WHERE w >= (hour + 97) * 3600000000), 99) AS closed FROM (SELECT DISTINCT kind, hour FROM h)),
j AS (SELECT h.*, due, closed FROM h JOIN p USING (kind, hour)),
t AS (SELECT kind, hour, batch, any_value(due) AS due, count(*) AS n, sum(cents) AS c FROM j WHERE batch < closed GROUP BY ALL),
u AS (SELECT *, sum(n) OVER o AS n_all, sum(c) OVER o AS c_all, min(batch) OVER (PARTITION BY kind, hour) AS first, max(batch) OVER (PARTITION BY kind, hour) AS final FROM t WINDOW o AS (PARTITION BY kind, hour ORDER BY batch)),
s AS (SELECT *, greatest(due, first) AS sent FROM u),
x AS (SELECT sent AS batch, hour, -1 AS click_id, max(n_all) AS n_rows, max_by(c_all, batch) AS cents, 'emit' AS record, kind FROM s WHERE sent <= 7 AND batch <= sent GROUP BY sent, hour, kind
  UNION ALL SELECT batch, hour, -1, n_all - n, c_all - c, 'retract', kind FROM s WHERE batch > sent
  UNION ALL SELECT batch, hour, -1, n_all, c_all, 'replace', kind FROM s WHERE batch > sent
  UNION ALL SELECT 7, hour, -1, n_all, c_all, 'final', kind FROM s WHERE sent > 7 AND batch = final
  UNION ALL SELECT batch, hour, click_id, 1, cents, 'late', kind FROM j WHERE batch >= closed)
SELECT batch::BIGINT AS batch, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents, record, kind FROM x""",
    "base_whitening": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT + 1000000) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT DISTINCT x FROM v), e AS (SELECT unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM f), s AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, sum(x)::BIGINT AS s FROM e GROUP BY i)), n AS (SELECT count(*) AS n FROM f)
SELECT vec_id, component::INT AS component, n, list_sum(list_transform(x, lambda c, i: (n * c - s[i]) ** 2))::BIGINT AS deviation FROM v, s, n, (SELECT unnest(range(1, 17)) AS component)""",
}
