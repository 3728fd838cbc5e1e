"""SQL of the registered queries that SQL can express, written from the contracts and run by another engine.

The others (packing, personal data, SimHash, page text, piece counts, byte-level BPE) are compared with brute-force
versions in tests/llm.
"""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

# A text's lines in normalised form, per document: one row per line with a word.
_LINES = rf"""
lined AS (
  SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
),
keyed AS (
  SELECT *, trim(regexp_replace(lower(line), '{_SPACE}', ' ', 'g'), ' ') AS key
  FROM lined
)"""

_OP7 = f"""
WITH {_LINES},
pages_of AS (SELECT coalesce('h' || source, '') AS host, count(*) AS host_pages FROM documents GROUP BY 1),
bad AS (
  SELECT host, key
  FROM (SELECT host, key, count(DISTINCT doc_id) AS n FROM keyed WHERE key <> '' GROUP BY 1, 2)
  JOIN pages_of USING (host)
  WHERE n >= 5 AND n > 0.05 * host_pages
),
marked AS (
  SELECT k.*, b.key IS NOT NULL AS gone FROM keyed k LEFT JOIN bad b ON k.host = b.host AND k.key = b.key
)
SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*) FILTER (WHERE key <> '') AS n_lines,
       count(*) FILTER (WHERE gone) AS n_removed_lines
FROM marked GROUP BY doc_id"""

_OP8 = rf"""
WITH {_LINES},
distinct_texts AS (SELECT host, count(DISTINCT text) AS host_docs FROM lined GROUP BY host),
frequent AS (
  SELECT host, key, n, host_docs
  FROM (SELECT host, key, count(DISTINCT text) AS n FROM keyed WHERE key <> '' GROUP BY 1, 2)
  JOIN distinct_texts USING (host)
  WHERE n >= 5 AND (n >= 0.1 * host_docs OR n >= 500)
),
copies AS (
  SELECT k.host, k.text
  FROM (SELECT DISTINCT host, text, pos, key, line FROM keyed WHERE key <> '') k
  LEFT JOIN frequent f ON f.host = k.host AND f.key = k.key
  GROUP BY k.host, k.text
  HAVING count(f.key) > 0 AND coalesce(sum(len(regexp_extract_all(line, '{_WORD}'))) FILTER (WHERE f.key IS NOT NULL), 0)
         >= 0.8 * sum(len(regexp_extract_all(line, '{_WORD}')))
),
copies_of_host AS (SELECT host, count(*) - 1 AS extra FROM copies GROUP BY host),
copies_of_line AS (
  SELECT host, key, count(DISTINCT text) - 1 AS extra FROM keyed JOIN copies USING (host, text) WHERE key <> '' GROUP BY 1, 2
),
bad AS (
  SELECT f.host, f.key FROM frequent f
  LEFT JOIN copies_of_host h ON h.host = f.host
  LEFT JOIN copies_of_line l ON l.host = f.host AND l.key = f.key
  WHERE n - coalesce(l.extra, 0) >= 5
    AND (n - coalesce(l.extra, 0) >= 0.1 * (host_docs - coalesce(h.extra, 0)) OR n - coalesce(l.extra, 0) >= 500)
),
removed AS (
  SELECT doc_id, sum(len(regexp_extract_all(line, '{_WORD}'))) AS n
  FROM keyed JOIN bad USING (host, key) GROUP BY doc_id
),
worded AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
),
spread AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM worded
),
windowed AS (
  SELECT doc_id, pos, word,
         lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third
  FROM spread WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
repeated AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n
  FROM windowed WHERE third IS NOT NULL
),
covered AS (
  SELECT doc_id, count(DISTINCT pos + step) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS step)
  WHERE n > 1 GROUP BY doc_id
),
dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM keyed WHERE key <> '' GROUP BY doc_id
),
measured AS (
  SELECT w.doc_id,
         len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(d.n, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         coalesce(r.n, 0)::BIGINT AS n_removed_words
  FROM worded w
  LEFT JOIN dup_lines d ON d.doc_id = w.doc_id
  LEFT JOIN covered c ON c.doc_id = w.doc_id
  LEFT JOIN removed r ON r.doc_id = w.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept
FROM measured"""

_OP9 = """
WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
grouped AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM hashed JOIN grouped USING (text_sha256)"""

_OP6 = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched_on,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
entries AS (
  SELECT entry, n FROM (
    SELECT entry, ('0x' || substr(md5(entry), 1, 8))::BIGINT AS n
    FROM (SELECT DISTINCT regexp_extract(host, '(?:[^.]*\.){0,2}[^.]*$') AS entry FROM hosts)
  ) WHERE n % 4 = 0
  UNION ALL
  SELECT entry, n FROM (
    SELECT host || '/de/' AS entry, ('0x' || substr(md5(host || '/de/'), 1, 8))::BIGINT AS n FROM hosts
  ) WHERE n % 5 = 0
),
dated AS (SELECT entry, n, DATE '2024-01-01' + ((n // 16) % 200)::INTEGER AS day FROM entries),
active AS (
  SELECT entry, day AS active_from, CASE WHEN (n // 4) % 3 = 0 THEN day + 40 END AS active_to FROM dated
  UNION ALL
  SELECT entry, day + 100, NULL FROM dated WHERE (n // 4) % 3 = 0 AND (n // 12) % 2 = 0
),
hits AS (
  SELECT DISTINCT c.page_id, a.entry
  FROM captures c JOIN active a
    ON c.fetched_on >= a.active_from AND (a.active_to IS NULL OR c.fetched_on < a.active_to)
   AND (CASE WHEN contains(a.entry, '/') THEN starts_with(c.host || rtrim(c.path, '/') || '/', a.entry)
             ELSE c.host = a.entry OR ends_with(c.host, '.' || a.entry) END)
)
SELECT c.page_id, c.url, c.fetched_on, count(h.entry) AS n_active,
       arg_min(h.entry, (-length(h.entry), h.entry)) AS entry, count(h.entry) > 0 AS blocked
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id
GROUP BY c.page_id, c.url, c.fetched_on"""


# Pairs are counted once per distinct set, and components spread the smallest number along links.
_OP11 = rf"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words
  FROM documents
),
shingled AS (
  SELECT id, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
           ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 1),
                          lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) END AS shingles
  FROM worded
),
classed AS (SELECT id, doc_id, shingles, dense_rank() OVER (ORDER BY shingles) AS class FROM shingled),
sets AS (SELECT class, any_value(shingles) AS shingles, min(doc_id) AS lowest FROM classed GROUP BY class),
tokens AS MATERIALIZED (SELECT class, len(shingles) AS n, unnest(shingles) AS token FROM sets),
links AS MATERIALIZED (
  SELECT a.class AS x, b.class AS y FROM tokens a JOIN tokens b ON a.token = b.token AND a.class <> b.class
  GROUP BY a.class, a.n, b.class, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reached AS (
  SELECT class AS x, class AS y FROM sets
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
),
components AS (SELECT x AS class, min(lowest) AS component_id FROM reached JOIN sets ON sets.class = reached.y GROUP BY x)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles,
       CASE WHEN len(shingles) = 0 THEN doc_id ELSE component_id END AS component_id
FROM classed JOIN components USING (class)"""

# CRC-32 of the decimal id: bytes folded in one by one, eight shifts each, with the reversed polynomial.
_OP12 = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
  SELECT c, xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                      lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
         ), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns)
),
rebuilt AS (
  SELECT c, 0 AS part, pos, role, text FROM ids JOIN turns ON conv_id = c - c % 5 AND pos < h
  UNION ALL
  SELECT c, 1, pos, role, text FROM ids JOIN turns ON conv_id = c AND pos >= h
),
numbered AS (
  SELECT c, octet_length(encode(text)) AS bytes, length(role)::VARCHAR || ':' || role || text AS turn,
         row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth
  FROM rebuilt
),
ending AS (SELECT c, max(depth) AS last FROM numbered GROUP BY c),
prefixes AS (
  SELECT c, depth, bytes, sha256(string_agg(sha256(turn), ' ') OVER (PARTITION BY c ORDER BY depth)) AS node FROM numbered
  UNION ALL
  SELECT c, 0, 0, '' FROM ids
),
linked AS (
  SELECT p.*, lag(node) OVER (PARTITION BY p.c ORDER BY depth) AS above, depth = coalesce(last, 0) AS ends
  FROM prefixes p LEFT JOIN ending e ON e.c = p.c
),
nodes AS (
  SELECT node, min(c) AS conv_id, any_value(depth) AS depth, any_value(above) AS above, count(*) AS n_convs,
         any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM linked GROUP BY node
),
children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
below AS (
  SELECT a.node, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved
  FROM nodes d
  LEFT JOIN children k ON k.node = d.node
  JOIN prefixes a ON a.c = d.conv_id AND a.depth <= d.depth
  GROUP BY a.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n
JOIN below b ON b.node = n.node
LEFT JOIN children k ON k.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.above"""

_OP13 = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
corpus AS (SELECT count(*) AS docs, sum(len(terms)) AS total FROM worded WHERE len(terms) > 0),
measured AS (SELECT doc_id, terms, 100 - 90 + (90 * len(terms) * docs) // total AS m FROM worded, corpus),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
postings AS (
  SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM measured)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS "rank", doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_lists": _OP6, "op7_line_dedup": _OP7, "op8_quality": _OP8, "op9_exact_dedup": _OP9, "op11_jaccard_join": _OP11, "op12_conversation_trie": _OP12, "op13_ranked_search": _OP13}
