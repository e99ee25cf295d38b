"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from navloom.llm.secret_scan import ACCESS, ASSIGN, HEX, LEAST_KINDS_OF_CHARACTERS, MAX_OWNERS, TOKEN

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES: dict[str, str] = {}

ORACLES["op1_minhash_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN words
        ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, min(root) = d.doc_id AS kept
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

ORACLES["op3_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words FROM documents),
v AS (SELECT doc_id, i, list_slice(words, i, i + 19) AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS nth FROM v) WHERE nth > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f),
t AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM t ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

ORACLES["op7_suffix_dedup"] = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
v AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM h)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM v) WHERE doc_id > first),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER p + 50 THEN 1 ELSE 0 END AS new FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY ALL),
p AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after, b FROM r
      UNION ALL SELECT doc_id, n, coalesce((SELECT max(b) FROM r WHERE r.doc_id = h.doc_id), 0), NULL FROM h),
k AS (SELECT doc_id, string_agg(substr(h, 2 * after::BIGINT + 1, 2 * (a - after)::BIGINT), '' ORDER BY a, b NULLS LAST) AS kept,
        sum(b - a) AS removed, count(b) AS spans FROM p JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM h JOIN k USING (doc_id)"""

ORACLES["op8_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS words FROM benchmark),
m AS (SELECT item_id, words, least(len(words), 10) AS n FROM b WHERE len(words) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM m)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS win
       FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM m))),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    pattern = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, owner, {kind} AS kind, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0))::BIGINT AS a,
        whole[i] AS whole, vals[i] AS val
      FROM (SELECT doc_id, owner, regexp_extract_all(text, {pattern}) AS whole, regexp_extract_all(text, {pattern}, {group}) AS vals,
              string_split_regex(text, {pattern}) AS gaps, unnest(range(1, len(regexp_extract_all(text, {pattern})) + 1)) AS i FROM d)
      WHERE length(vals[i]) >= {least}"""


ORACLES["op9_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
base AS ({_found(0, ASSIGN, 1, 8)} UNION ALL {_found(1, ACCESS, 0, 1)} UNION ALL {_found(2, HEX, 0, 1)}),
tok AS (SELECT * FROM ({_found(3, TOKEN, 0, 1)}) WHERE regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')),
mixed AS (SELECT * FROM tok WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = tok.doc_id AND base.a < tok.a + length(tok.whole) AND tok.a < base.a + length(base.whole))),
own AS (SELECT val FROM (SELECT val, owner FROM base UNION ALL SELECT val, owner FROM mixed) GROUP BY val HAVING count(DISTINCT owner) <= {MAX_OWNERS}),
live AS (SELECT * FROM mixed SEMI JOIN own USING (val) WHERE len(list_distinct(string_split(val, ''))) >= {LEAST_KINDS_OF_CHARACTERS}),
s AS (SELECT doc_id, kind, a, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || a || ':' || (a + length(whole)) AS span
      FROM (SELECT * FROM base UNION ALL SELECT * FROM live)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS x, count(*) FILTER (kind = 1) AS y, count(*) FILTER (kind = 2) AS z,
        string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY a, kind) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(x, 0)::BIGINT AS n_assign, coalesce(y, 0)::BIGINT AS n_access, coalesce(z, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)"""

ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f"""

# crc32 of a decimal number: the polynomial's table, then one step per digit
_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
numbered AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) AS h FROM documents, crc)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", chars, "text"))) + ")"


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC},
leaf AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN h % 7 = 0 THEN {_leaf('n_chars + 1')} END AS tampered,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM numbered),
node AS (SELECT lang, 0 AS level, r, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaf
  UNION ALL SELECT lang, level + 1, r // 2, h, (n + 1) // 2
  FROM (SELECT lang, level, r, n, sha256(h || coalesce(lead(h) OVER (PARTITION BY lang ORDER BY r), '')) AS h FROM node WHERE n > 1) WHERE r % 2 = 0),
sub AS (SELECT lang, h AS subroot, max(level) OVER () AS deep, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM node WHERE n = 1),
top AS (SELECT 0 AS level, r, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT level + 1, r // 2, h, (n + 1) // 2
  FROM (SELECT level, r, n, sha256(h || coalesce(lead(h) OVER (ORDER BY r), '')) AS h FROM top WHERE n > 1) WHERE r % 2 = 0),
steps AS (SELECT l.doc_id, p.level, CASE WHEN p.r % 2 = 1 THEN q.h ELSE '' END AS before, CASE WHEN p.r % 2 = 0 THEN coalesce(q.h, '') ELSE '' END AS after
  FROM leaf l JOIN node p ON p.lang IS NOT DISTINCT FROM l.lang AND p.r = l.r // (1 << p.level) AND p.n > 1
  LEFT JOIN node q ON q.lang IS NOT DISTINCT FROM p.lang AND q.level = p.level AND q.r = xor(p.r, 1)
  UNION ALL SELECT l.doc_id, s.deep + p.level, CASE WHEN p.r % 2 = 1 THEN q.h ELSE '' END, CASE WHEN p.r % 2 = 0 THEN coalesce(q.h, '') ELSE '' END
  FROM leaf l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top p ON p.r = s.r // (1 << p.level) AND p.n > 1
  LEFT JOIN top q ON q.level = p.level AND q.r = xor(p.r, 1)),
path AS (SELECT doc_id, list([before, after] ORDER BY level) AS path FROM steps GROUP BY doc_id),
full_ AS (SELECT l.doc_id, leaf, coalesce(tampered, leaf) AS start, subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(path, []) AS path
  FROM leaf l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN path USING (doc_id)),
done AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_concat([''], list_transform(path, lambda s: s[1] || s[2])), lambda a, b: a || b), '')) AS proof_sha256,
  list_reduce(list_concat([['', start]], path), lambda a, s: ['', sha256(s[1] || a[2] || s[2])])[2] AS folded_root FROM full_)
SELECT *, folded_root = root AS verified FROM done"""

ORACLES["op13_periodic_runs"] = f"""
WITH {_CRC},
split AS (SELECT doc_id, h % 10 = 0 AS edit, h // 10 AS g, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words FROM numbered),
pos AS (SELECT *, len(words) AS n, CASE WHEN len(words) > 0 THEN g % len(words) END AS a FROM split),
per AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM pos),
w AS (SELECT doc_id, n, CASE WHEN edit AND n > 0 THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END AS words FROM per),
t AS (SELECT doc_id, n, unnest(words) AS word, unnest(range(n)) AS i FROM w),
m AS (SELECT x.doc_id, x.i - y.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND 3 * (x.i - y.i) <= x.n AND x.n >= 24),
s AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND i >= start + q AND i < start + length) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM r GROUP BY doc_id),
b AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id
      AND (o.length * r.q > r.length * o.q OR (o.length * r.q = r.length * o.q AND (o.start < r.start OR (o.start = r.start AND o.q < r.q))))))
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN l USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""
