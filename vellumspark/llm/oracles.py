"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from . import line_dedup, mixing, url_filter

#: Levels of the URL tree that are written out: more than any path of the tables has.
LEVELS = 9
#: Words of a text, as in common.WORD.
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

LINE_DEDUP = f"""
WITH cut AS (
    SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), said AS (
    SELECT r, doc_id, source, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM cut
), bare AS (
    SELECT *, trim(regexp_replace(line, '[\\x09-\\x0D]', ' ', 'g'), ' ') AS k FROM said
), pages AS (
    SELECT source, count(*) AS pages FROM documents GROUP BY source
), bad AS (
    SELECT b.source, b.k FROM bare b JOIN pages p ON b.source IS NOT DISTINCT FROM p.source
    WHERE k <> '' GROUP BY b.source, b.k, p.pages
    HAVING count(DISTINCT r) >= {line_dedup.MIN_PAGES} AND count(DISTINCT r) > {line_dedup.RATIO} * p.pages
), marked AS (
    SELECT b.*, d.k IS NOT NULL AS gone FROM bare b LEFT JOIN bad d ON b.source IS NOT DISTINCT FROM d.source AND b.k = d.k
), joined AS (
    SELECT r, count(*) FILTER (WHERE gone) AS n, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY r
)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE kept END AS text, coalesce(n, 0)::INTEGER AS lines_dropped
FROM cut LEFT JOIN joined USING (r)
"""

MIXING = f"""
WITH sized AS (
    SELECT doc_id, source, {WORDS}::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS u
    FROM documents
), weighed AS (
    SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), state AS (
    SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS wall,
        coalesce(sum(source_size) OVER o, 0) AS stopped, coalesce(sum(w) OVER o, 0) AS wstopped
    FROM weighed
    WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
    SELECT *, (total - {mixing.MOST} * stopped)::DOUBLE / (wall - wstopped)::DOUBLE AS lv FROM state
), goal AS (
    SELECT source, source_size, least(({mixing.MOST} * source_size)::DOUBLE, max(CASE WHEN lv * w <= {mixing.MOST} * source_size THEN lv END) OVER () * w) AS target
    FROM levels
), need AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds,
        target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS need
    FROM goal
), bins AS (
    SELECT source, u, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY u) AS upto FROM sized GROUP BY source, u
), inside AS (
    SELECT b.source, b.u, upto <= need OR (upto - need <= need - (upto - s) AND upto - need < s) AS ok
    FROM bins b JOIN need n ON b.source IS NOT DISTINCT FROM n.source
), below AS (
    SELECT source, coalesce(min(CASE WHEN NOT ok THEN u END), max(u) + 1) AS below FROM inside GROUP BY source
)
SELECT doc_id, size, source_size, target, size * (rounds + CASE WHEN u < below THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN need n ON d.source IS NOT DISTINCT FROM n.source JOIN below b ON d.source IS NOT DISTINCT FROM b.source
"""




def url_filter_sql() -> str:
    u = url_filter
    rule = verdict = ""
    for text, word in sorted(u.RULES, key=lambda r: (-len(r[0]), r[0])):
        host, slash, rest = text.partition("/")
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}')"
        rule, verdict = f"{rule} {fits} THEN '{text}'", f"{verdict} {fits} THEN '{word}'"
    levels = ""
    for k in range(LEVELS):
        levels += f"""
, r{k} AS (SELECT *, CASE WHEN len(string_split(shape, '/')) > {k} THEN string_split(shape, '/')[{k + 1}] ELSE '' END AS part FROM t{k})
, c{k} AS (SELECT host, template, part, sum(n) AS n, sum(m)::DOUBLE AS m, sum(b)::DOUBLE AS b FROM r{k} GROUP BY host, template, part)
, p{k} AS (SELECT host, template, sum(n) AS na, sum(m)::DOUBLE AS ma, sum(b)::DOUBLE AS ba FROM r{k} GROUP BY host, template)
, s{k} AS (
    SELECT host, template, part, CASE WHEN part = '' THEN '' WHEN n >= {u.SUPPORT}  AND m >= {u.BRANCH_LABELS} AND ma - m >= {u.BRANCH_LABELS} AND ba > 0 AND ba < ma
        AND abs(b / m - (ba - b) / (ma - m)) > {u.DIFFER} * sqrt((b + (ba - b)) / (m + (ma - m)) * (1 - (b + (ba - b)) / (m + (ma - m))) * (1 / m + 1 / (ma - m)))
        THEN '/' || part ELSE '/*' END AS step
    FROM c{k} JOIN p{k} USING (host, template))
, t{k + 1} AS (SELECT host, shape, n, m, b, template || step AS template FROM r{k} JOIN s{k} USING (host, template, part))"""
    return f"""
WITH parsed AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '{u.PARTS}', 1), '{u.UPPER}', '{u.LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '{u.PARTS}', 2), '') AS path
    FROM pages
), cut AS (
    SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '*', 'g')) AS ps FROM parsed
), shaped AS (
    SELECT page_id, host, path, coalesce(array_to_string(ps, '/'), '') AS shape FROM cut
), marks AS (
    SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad
    FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
), t0 AS (
    SELECT host, shape, count(*) AS n, count(bad) AS m, coalesce(sum(bad), 0) AS b, '' AS template
    FROM shaped LEFT JOIN marks ON page_id = doc_id GROUP BY host, shape
){levels}
, whole AS (SELECT coalesce(sum(b)::DOUBLE / nullif(sum(m), 0), 0) AS base FROM t{LEVELS})
, hosts AS (SELECT host, sum(b) AS hb, sum(m) AS hm FROM t{LEVELS} GROUP BY host)
, each AS (SELECT host, template, sum(b) AS b, sum(m) AS m FROM t{LEVELS} GROUP BY host, template HAVING sum(m) >= {u.TEMPLATE_LABELS})
, bad AS (
    SELECT host, template FROM each JOIN hosts USING (host), whole
    WHERE (b + {u.PRIOR}::DOUBLE * ((hb + {u.PRIOR}::DOUBLE * base) / (hm + {u.PRIOR}::DOUBLE))) / (m + {u.PRIOR}::DOUBLE) > {u.REJECT}
)
SELECT page_id, host, path, CASE{rule} ELSE NULL END AS rule,
    CASE{verdict} WHEN (host, t.template) IN (SELECT (host, template) FROM bad) THEN 'block' ELSE 'allow' END AS verdict, t.template AS template
FROM shaped JOIN t{LEVELS} t USING (host, shape)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP, "op5_url_filter": url_filter_sql(), "op8_mixing": MIXING}
