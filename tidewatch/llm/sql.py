"""DuckDB SQL of the registered queries that SQL can express."""

OP4_SQL = """
WITH rows AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY norm)
"""

OP11_SQL = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
           sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS drawn
    FROM documents
), drawn AS (
    SELECT *, len(units) AS n,
           ('0x' || drawn[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || drawn[9:16])::BIGINT % (len(units) + 1) AS c2,
           ('0x' || drawn[17:24])::BIGINT % 100 AS h3, ('0x' || drawn[25:32])::BIGINT % 100 AS h4
    FROM cut
), parts AS (
    SELECT *,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50
                THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(units[1:least(c1, c2)], '') AS prefix,
           array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
           array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

OP12_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
    SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), often AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), judged AS (
    SELECT r, line, i, key IN (SELECT key FROM often) AS goes FROM keyed
), texts AS (
    SELECT r, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '') AS kept
    FROM judged GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM docs JOIN texts USING (r)
"""

# CRC-32 bit by bit: each byte is taken in, then eight shifts follow it.
OP13_SQL = """
WITH ids AS (
    SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), drawn AS (
    SELECT conv_id, conv_id - conv_id % 20 AS leader,
           xor(list_reduce(
               list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                   lambda d: list_concat([ascii(d)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
           ), 4294967295) % 4 AS h
    FROM ids
), hashed AS (
    SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS step,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
    FROM conversations
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, step) AS pos FROM hashed
), rebuilt AS (
    SELECT d.conv_id, p.pos, step, words FROM drawn d JOIN placed p ON p.conv_id = d.leader AND p.pos <= h
    UNION ALL
    SELECT d.conv_id, p.pos, step, words FROM drawn d JOIN placed p ON p.conv_id = d.conv_id AND p.pos > h
), numbered AS (
    SELECT conv_id, step, words, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt
), prefixes AS (
    SELECT conv_id, depth, words, string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM numbered
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM ids
), lengths AS (
    SELECT conv_id, max(depth) AS turns FROM prefixes GROUP BY conv_id
), nodes AS (
    SELECT depth, path, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
           sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (depth = turns), '')) AS ends_sha256,
           count(*) FILTER (depth < turns) = 0 AS leaf
    FROM prefixes p JOIN lengths USING (conv_id) GROUP BY depth, path
), subtrees AS (
    SELECT left(n.path, 32 * a.depth) AS path, a.depth,
           sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves,
           count(*) FILTER (n.depth = a.depth + 1) AS n_children
    FROM nodes n, LATERAL (SELECT unnest(range(n.depth + 1)) AS depth) a GROUP BY 1, 2
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 32 * (n.depth - 1))
"""
