"""The queries of this package in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_LOWER = "abcdefghijklmnopqrstuvwxyz"

_REVISITS = r"""
WITH captures AS (
    SELECT page_id * 4 + i AS record_id,
           i > 0 AS revisit,
           regexp_replace(
               CASE WHEN i = 0 THEN url ELSE regexp_replace(url, '#.*$', '') || '#again' END,
               '#.*$', '') AS url,
           CASE i WHEN 0 THEN page_id * 100
                  WHEN 1 THEN page_id * 100 + CASE WHEN page_id % 3 = 0 THEN -7 ELSE 7 END
                  WHEN 2 THEN page_id * 100 + 20 ELSE page_id * 100 + 30 END AS "at",
           page_id, i, md5(coalesce(html, '')) AS tag,
           'day ' || (page_id % 365) AS day, length(html) AS n
    FROM pages, (SELECT unnest([0, 1, 2, 3]) AS i)
), split AS (
    SELECT *, regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM captures
), parts AS (
    SELECT *,
           regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''),
                          ':(?:80|443)$', '') AS host,
           regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
           list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|gclid|fbclid|ref)(?:=|$)')
           )) AS wanted
    FROM split
), keyed AS (
    SELECT *, host || path ||
           CASE WHEN len(wanted) > 0 THEN '?' || array_to_string(wanted, '&') ELSE '' END AS key
    FROM parts
), seen AS (
    SELECT *, last_value(CASE WHEN NOT revisit THEN
                 {'id': record_id, 'at': "at", 'tag': tag, 'day': day, 'n': n} END IGNORE NULLS)
               OVER (PARTITION BY key ORDER BY "at", NOT revisit, record_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found
    FROM keyed
), judged AS (
    SELECT *, CASE
        WHEN found IS NULL THEN 'missing'
        WHEN i = 2 THEN CASE WHEN found.day = day THEN 'resolved' ELSE 'changed' END
        WHEN i = 3 AND page_id % 5 < 2 THEN 'changed'
        WHEN found.tag = tag THEN 'resolved' ELSE 'changed' END AS outcome
    FROM seen WHERE revisit
)
SELECT record_id, key AS canonical_url, "at", outcome,
       CASE WHEN outcome = 'resolved' THEN found.id END AS response_id,
       CASE WHEN outcome = 'resolved' THEN found."at" END AS response_at,
       CASE i
       WHEN 1 THEN CASE WHEN outcome = 'resolved'
            THEN 'Last-Modified=' || found.day || ';Content-Length=' || found.n || ';' ELSE '' END
            || 'etag=W/' || tag || ';Date=' || (page_id * 100 + 7)
       WHEN 2 THEN CASE WHEN outcome = 'resolved'
            THEN 'ETag=' || found.tag || ';Content-Length=' || found.n || ';Date=' || found."at"
                 || ';Last-Modified=' || day
            ELSE 'Last-Modified=' || day || ';Content-Length=0' END
       ELSE CASE WHEN outcome = 'resolved'
            THEN 'Last-Modified=' || found.day || ';Content-Length=' || found.n || ';Date=' || found."at"
                 || ';' ELSE '' END
            || 'ETag=' || CASE WHEN page_id % 5 < 2 THEN 'new' ELSE tag END
            || ';Expires=' || (page_id * 100 + 1000)
       END AS headers,
       record_id // 4 AS page_id
FROM judged
"""

_LINES = rf"""
WITH lines AS (
    SELECT doc_id, pos, line,
           translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''),
                                    '[\x20\x09-\x0D]+$', ''),
                     '{_LOWER.upper()}', '{_LOWER}') AS key
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), common AS (
    SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT doc_id, pos, line, holder IS NOT NULL AND holder <> doc_id AS gone
    FROM lines LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
           AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WORDS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{_LOWER.upper()}', '{_LOWER}'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_IMPORTANCE = rf"""
WITH RECURSIVE bits(byte, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL
    SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    FROM bits WHERE k < 8
), crc_table AS (
    SELECT list(c ORDER BY byte) AS entries FROM bits WHERE k = 8
), words AS (
    SELECT 0 AS kind, row_number() OVER () AS place, doc_id, {_WORDS} AS w FROM documents
    UNION ALL
    SELECT 1, row_number() OVER (), NULL, {_WORDS} FROM benchmark
), runs AS (
    SELECT kind, place, unnest(w) AS run FROM words
    UNION ALL
    SELECT kind, place, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
    FROM words
), counted AS (
    SELECT kind, place, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
    SELECT run, xor(list_reduce(
               list_prepend(CAST(4294967295 AS BIGINT),
                   list_transform(range(1, octet_length(encode(run)) + 1), lambda i:
                       CAST(('0x' || substr(hex(encode(run)), 2 * i - 1, 2)) AS BIGINT))),
               lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT run FROM counted), crc_table
), features AS (
    SELECT kind, place, bucket, sum(n) AS n FROM counted JOIN hashed USING (run) GROUP BY ALL
), totals AS (
    SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t
    FROM features GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln(
               ((CAST(t AS DOUBLE) + 1) * CAST((SELECT sum(s) FROM totals) + 10000 AS DOUBLE))
               / ((CAST(s AS DOUBLE) + 1) * CAST((SELECT sum(t) FROM totals) + 10000 AS DOUBLE)))) AS gain
    FROM totals
), weights AS (
    SELECT place, sum(n) AS n, floor(sum(gain * n) / sum(n)) AS weight
    FROM features JOIN gains USING (bucket) WHERE kind = 0 GROUP BY place
), scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(
               ('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5)
               / CAST(4294967296 AS DOUBLE)))) AS score
    FROM words LEFT JOIN weights USING (place) WHERE kind = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS rank,
           25 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS quota
    FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight,
       CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND rank <= quota THEN CAST(rank AS BIGINT) END AS rank,
       CAST(n_words AS BIGINT) AS n_words
FROM ranked
"""

_LEAKS = rf"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS place, {_WORDS} AS w FROM documents
), items AS (
    SELECT item_id, {_WORDS} AS w FROM benchmark
), cuts AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size,
           array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS words
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
          FROM items WHERE len(w) > 0)
), runs AS (
    SELECT place, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words
    FROM (SELECT place, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM docs, (SELECT DISTINCT size FROM cuts))
), found AS (
    SELECT place, size, i, item_id FROM runs JOIN cuts USING (size, words)
), hits AS (
    SELECT place, count(DISTINCT spot) AS n_hit
    FROM (SELECT place, unnest(range(i, i + size)) AS spot FROM found) GROUP BY place
), named AS (
    SELECT place, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT place, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL)
    GROUP BY place
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (place) LEFT JOIN named USING (place)
"""

#: The others rest on hashes, token ids or iterations that SQL lacks, or on positions of
#: matches; they are tested against brute force.
ORACLE: dict[str, str] = {
    "op2_revisits": _REVISITS,
    "op6_line_dedup": _LINES,
    "op11_importance_resampling": _IMPORTANCE,
    "op13_decontamination": _LEAKS,
}
