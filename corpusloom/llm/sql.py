"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

#: Lower-cases A-Z only.
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark),
i2 AS (SELECT item, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT item, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS s FROM i2)
),
lens AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS s FROM d, lens WHERE len(w) >= k)
),
hit AS (SELECT dw.doc_id, dw.s, dw.k, win.item FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP5 = r"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
freq AS (
  SELECT source, trim(line, ' ' || chr(9) || chr(13)) AS k, count(DISTINCT doc_id) AS n FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY ALL
),
bad AS (
  SELECT f.source, f.k FROM freq f JOIN pages p ON f.source IS NOT DISTINCT FROM p.source
  WHERE f.n >= 2 AND f.n > CAST(0.1 AS DOUBLE) * p.pages
),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL) AS t,
    count(bad.k) AS lines_dropped
  FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND trim(l.line, ' ' || chr(9) || chr(13)) = bad.k
  GROUP BY l.doc_id
)
SELECT d.doc_id, sha256(coalesce(CASE WHEN lines_dropped > 0 THEN kept.t ELSE d.text END, '')) AS text_sha256,
  coalesce(lines_dropped, 0) AS lines_dropped
FROM documents d LEFT JOIN kept USING (doc_id)
"""

OP8 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""



def _op10() -> str:
    """The spans of every kind, the owners of each value, and what follows from them."""
    from corpusloom.llm.secrets import ADDED_KINDS, BASE_KINDS, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_CHARS

    kinds = []
    for rank, (kind, pattern, group, least) in enumerate([*BASE_KINDS, *ADDED_KINDS]):
        p = pattern.replace("'", "''")
        # Lengths of the pieces between matches and of the matches give the offsets.
        kinds.append(f"""
  SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, {least} AS least,
    unnest(regexp_extract_all(t, '{p}', 0)) AS hit, unnest(regexp_extract_all(t, '{p}', {group})) AS v,
    unnest(regexp_split_to_array(t, '{p}')[1:len(regexp_extract_all(t, '{p}', 0))]) AS gap,
    unnest(range(len(regexp_extract_all(t, '{p}', 0)))) AS i
  FROM d WHERE len(regexp_extract_all(t, '{p}', 0)) > 0""")
    base = len(BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{k[0]}" for i, k in enumerate(BASE_KINDS))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
s AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i)::BIGINT AS stop FROM m),
f AS (SELECT doc_id, source, rank, kind, stop - length(hit) AS start, stop, v FROM s WHERE length(v) >= least),
o AS (SELECT v, sum(first_owner) AS owners, sum(first_repository) AS repositories FROM (
  SELECT v, CASE WHEN row_number() OVER (PARTITION BY v, source) = 1 THEN 1 ELSE 0 END AS first_owner,
    CASE WHEN row_number() OVER (PARTITION BY v, source, doc_id) = 1 THEN 1 ELSE 0 END AS first_repository FROM f) GROUP BY v),
j AS (SELECT f.*, repositories, CASE WHEN owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} THEN 'example' WHEN len(list_distinct(string_split(f.v, ''))) >= {LIVE_CHARS} THEN 'live' ELSE 'weak' END AS verdict
  FROM f JOIN o ON f.v = o.v),
k AS (SELECT * FROM j WHERE rank < {base} OR verdict = 'live'),
a AS (SELECT doc_id, {counts},
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < {base}) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
  count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example,
  CAST(max(repositories) AS BIGINT) AS most FROM k GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  coalesce(most, 0) AS most_repositories
FROM d LEFT JOIN a USING (doc_id)
"""


OP7 = """
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM range(256) AS t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
),
tab AS (SELECT list(v ORDER BY i) AS tb FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, t, hex(encode(t)) AS x FROM d),
y AS (SELECT doc_id, t, list_transform(range(1, length(x), 2), lambda p: (instr('0123456789ABCDEF', x[p:p]) - 1) * 16 + instr('0123456789ABCDEF', x[p + 1:p + 1]) - 1) AS bytes FROM h),
z AS (SELECT doc_id, len(bytes) + 8 AS size,
  xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM y, tab),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM z),
g AS (SELECT doc_id, size, text_crc32, CAST(((2 * upto - size) * 24) // (2 * total) AS INT) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM g
"""

SQL: dict[str, str] = {
    "op7_byte_shards": OP7,
    "op10_secret_scan": _op10(),
    "op4_decontaminate": OP4,
    "op5_line_dedup": OP5,
    "op8_exact_dedup": OP8,
}
