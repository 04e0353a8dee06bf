"""The text operators in DuckDB SQL, where SQL can express them whole."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = r"""
WITH sized AS (
    SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        left(sha256(concat('17:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 32) AS key
    FROM documents
),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source
),
-- The level at which capped sources and the others' shares use up the total: the one
-- that fits its own set of capped sources.
levels AS (
    SELECT *, 2 * source_size / weight AS ratio,
        (SELECT sum(source_size) FROM sources) AS words
    FROM sources
),
tried AS (
    SELECT a.ratio,
        (a.words * 1.5::DOUBLE - coalesce((SELECT sum(2 * b.source_size) FROM levels b WHERE b.ratio < a.ratio), 0)::DOUBLE)
        / (SELECT sum(b.weight) FROM levels b WHERE b.ratio >= a.ratio)::DOUBLE AS level
    FROM levels a
),
chosen AS (SELECT arg_min(level, ratio) AS level FROM tried WHERE ratio >= level),
targets AS (
    SELECT source, source_size,
        coalesce(least(2.0::DOUBLE * source_size, weight * level), 2.0::DOUBLE * source_size) AS target
    FROM sources, chosen
),
placed AS (
    SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
        CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS copies,
        coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
),
final AS (
    SELECT *, greatest(0, least(size, budget - copies * source_size - before)) AS cut FROM placed
)
SELECT doc_id, size, source_size, target, (copies * size + cut)::BIGINT AS taken,
    copies::BIGINT AS copies, cut::BIGINT AS cut
FROM final
"""

OP7 = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
-- Kinds in the order of the result, with the pattern and the part that is measured.
kinds(kind, name, pattern, part, least) AS (VALUES
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    (1, 'access', 'AKIA[A-Z0-9]{16,}', 0, 20),
    (2, 'hex', '[0-9a-f]{24,}', 0, 24),
    (3, 'run', '[A-Za-z0-9+/_=-]{20,}', 0, 20)
),
found AS (
    SELECT r, kind, name, least, text,
        regexp_split_to_array(text, pattern) AS gaps,
        regexp_extract_all(text, pattern, 0) AS matches,
        CASE part WHEN 2 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern, 0) END AS parts
    FROM texts, kinds
),
placed AS (
    SELECT r, kind, name, least, unnest(matches) AS match, unnest(parts) AS part,
        unnest(list_transform(range(1, len(matches) + 1), lambda i: CAST(
            coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
            + coalesce(list_sum(list_transform(matches[1:i - 1], lambda m: length(m))), 0) AS BIGINT))) AS start
    FROM found
),
spans AS (
    SELECT r, kind, name, match, start, start + length(match) AS stop
    FROM placed WHERE length(part) >= least
),
base AS (SELECT r, kind, name, start, stop FROM spans WHERE kind < 3),
cut AS (
    SELECT r, match, start,
        regexp_split_to_array(lower(match), 'example|sample|placeholder|changeme|dummy|lorem|xxxx|0000000|1234567|abcdefg|deadbeef|sha(1|256|384|512)-|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS gaps,
        regexp_extract_all(lower(match), 'example|sample|placeholder|changeme|dummy|lorem|xxxx|0000000|1234567|abcdefg|deadbeef|sha(1|256|384|512)-|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS parts
    FROM spans
    WHERE kind = 3 AND regexp_matches(match, '[0-9]')
),
pieces AS (
    SELECT r, start + skipped AS start, substr(match, skipped + 1, length(gaps[i])) AS match
    FROM (
        SELECT *, CAST(coalesce(list_sum(list_transform(gaps[1:i - 1], lambda g: length(g))), 0)
            + coalesce(list_sum(list_transform(parts[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS skipped
        FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM cut)
    )
),
runs AS (
    SELECT r, match, start,
        CASE WHEN regexp_full_match(match, '[0-9a-f]+|[0-9A-F]+') THEN 3
            WHEN regexp_full_match(match, '[A-Za-z0-9]+') THEN 4 ELSE 5 END AS kind
    FROM pieces WHERE length(match) >= 20
),
windows AS (
    SELECT r, kind, start AS run, start + i AS start,
        list_entropy(string_split(substr(match, i + 1, 20), '')) AS bits
    FROM (SELECT *, unnest(range(0, length(match) - 19)) AS i FROM runs)
),
dense AS (
    SELECT r, kind, run, start,
        sum(fresh) OVER (PARTITION BY r, run ORDER BY start) AS part
    FROM (
        SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY r, run ORDER BY start) <= 20 THEN 0 ELSE 1 END AS fresh
        FROM windows WHERE bits >= [3.05, 3.55, 3.75][kind - 2]
    )
),
added AS (
    SELECT r, kind, ['entropy_hex', 'entropy_alnum', 'entropy_base64'][kind - 2] AS name, min(start) AS start, max(start) + 20 AS stop
    FROM dense GROUP BY r, kind, run, part
),
everything AS (
    SELECT *, true AS based FROM base
    UNION ALL
    SELECT *, false FROM added a
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.start <= a.start AND a.stop <= b.stop)
),
joined AS (
    SELECT r,
        count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access,
        count(*) FILTER (name = 'hex') AS n_hex,
        string_agg(concat(name, ':', start, ':', stop), ',' ORDER BY start, kind, stop) FILTER (based) AS base,
        string_agg(concat(name, ':', start, ':', stop), ',' ORDER BY start, kind, stop) AS spans
    FROM everything GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (r)
"""

OP10 = f"""
WITH rows AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
kept AS (
    SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY ALL
)
SELECT doc_id, keep_id, group_size,
    doc_id IS NOT DISTINCT FROM keep_id
        AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept,
    text_sha256
FROM rows JOIN kept USING (text_sha256)
"""

OP11 = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
kinds(kind, name, pattern, proposed, confirmed, named, words) AS (VALUES
    (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', 60, 30, 10, 'e-?mail'),
    (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', 40, 30, 20, 'host'),
    (2, 'card', '[0-9]([\x20-]?[0-9])+', 40, 40, 20, 'card'),
    (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', 50, 30, 20, 'phone'),
    (4, 'iban', '[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?', 20, 50, 20, 'iban|account|bank|konto|compte|cuenta'),
    (5, 'ssn', '[0-9]+-[0-9]+-[0-9]+', 25, 15, 35, 'ssn|social security|tax'),
    (6, 'personal', '[0-9]{6}([0-9]{2})?[-+]?[0-9]{4}', 20, 25, 30, 'personnummer|personal (id|number)|born|identity|id no'),
    (7, 'local_phone', '\(?[0-9]{3}\)?[-.\x20]{0,2}[0-9]{3}[-.\x20][0-9]{4}', 25, 15, 30, 'tel|phone|call|mobil|fax|whatsapp|ring|anruf')
),
found AS (
    SELECT r, kinds.*, regexp_split_to_array(text, pattern) AS gaps, regexp_extract_all(text, pattern, 0) AS matches
    FROM texts, kinds
),
numbered AS (SELECT *, unnest(range(1, len(matches) + 1)) AS i FROM found WHERE len(matches) > 0),
placed AS (
    SELECT * EXCLUDE (gaps, matches), matches[i] AS match,
        right(gaps[i], 48) AS before, left(gaps[i + 1], 24) AS after,
        CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
            + coalesce(list_sum(list_transform(matches[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS start,
        regexp_replace(matches[i], '[^0-9]', '', 'g') AS digits
    FROM numbered
),
checked AS (
    SELECT *, start + length(match) AS stop,
        lower(concat(before, ' ', after)) AS around,
        NOT regexp_matches(concat(right(before, 1), left(after, 1)), '[A-Za-z0-9]') AS alone,
        right(digits, CASE kind WHEN 6 THEN 10 ELSE 19 END) AS number,
        replace(match, ' ', '') AS plain
    FROM placed
),
judged AS (
    SELECT *,
        list_sum(list_transform(range(0, length(number)), lambda k: CAST(
            CASE WHEN k % 2 = 0 THEN CAST(reverse(number)[k + 1] AS INT)
                WHEN CAST(reverse(number)[k + 1] AS INT) > 4 THEN 2 * CAST(reverse(number)[k + 1] AS INT) - 9
                ELSE 2 * CAST(reverse(number)[k + 1] AS INT) END AS BIGINT))) % 10 = 0 AS luhn,
        list_reduce([0] || list_transform(string_split(concat(plain[5:], plain[1:4]), ''), lambda c: ascii(c)),
            lambda rest, c: CASE WHEN c < 65 THEN (rest * 10 + c - 48) % 97 ELSE (rest * 100 + c - 55) % 97 END) = 1 AS mod97
    FROM checked
),
confirmed AS (
    SELECT *, CASE kind
        WHEN 0 THEN true
        WHEN 1 THEN list_bool_and(list_transform(string_split(match, '.'), lambda part: regexp_full_match(part, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})')))
        WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND luhn
        WHEN 3 THEN length(digits) BETWEEN 9 AND 15
        WHEN 4 THEN alone AND mod97
        WHEN 5 THEN alone AND regexp_full_match(match, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(match, '^000|^666|^9|-00-|-0000$')
        WHEN 6 THEN alone AND luhn AND regexp_full_match(match, '([0-9]{2})?[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[-+]?[0-9]{4}')
        ELSE alone AND regexp_matches(match, '^\(?[2-9]') END AS good
    FROM judged
),
scored AS (
    SELECT r, kind, name, start, stop, kind < 4 AS based, good,
        proposed + CASE WHEN good THEN confirmed ELSE 0 END + CASE WHEN regexp_matches(around, words) THEN named ELSE 0 END
        - CASE WHEN regexp_matches(around, 'order|invoice|article|isbn|serial|version|sku|part no|item no') THEN 25 ELSE 0 END AS score
    FROM confirmed
),
taken AS (
    SELECT *,
        coalesce(max(stop) OVER (PARTITION BY r ORDER BY start, kind, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS furthest,
        coalesce(min(start) FILTER (based) OVER (PARTITION BY r ORDER BY start, kind, stop ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), stop) AS nearest
    FROM scored WHERE good AND (based OR score >= 60)
),
joined AS (
    SELECT r,
        count(*) FILTER (name = 'email') AS n_email, count(*) FILTER (name = 'ip') AS n_ip,
        count(*) FILTER (name = 'card') AS n_card, count(*) FILTER (name = 'phone') AS n_phone,
        string_agg(concat(name, ':', start, ':', stop), ',' ORDER BY start, kind, stop) FILTER (based) AS base,
        string_agg(concat(name, ':', start, ':', stop), ',' ORDER BY start, kind, stop) AS spans
    FROM taken WHERE based OR start >= furthest AND stop <= nearest
    GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
    coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (r)
"""

OP12 = r"""
WITH RECURSIVE
crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS crcs
    FROM range(256) t(i)
),
convs AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
fated AS (
    SELECT conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(
            [4294967295] || list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':',
                coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
    FROM (SELECT conv, c.* FROM conversations c JOIN convs ON c.conv_id IS NOT DISTINCT FROM convs.conv_id), crc_table
),
broken AS (
    SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM fated WHERE fate <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, digest) AS i
    FROM (SELECT *, left(sha256(concat(role, chr(0), text)), 32) AS digest FROM broken)
),
judged AS (
    SELECT conv, i, turn, role, text, substr(role, 1, 1) AS initial,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
            WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
    FROM placed
),
-- Insertions from one place of the pattern to another, and the edits of a message there.
inserts(p, q, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
steps(p, letter, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits(p, letter, q, edit, cost) AS (
    SELECT p, letter, q, 'K', 0 FROM steps
    UNION ALL SELECT p, letter, q, 'R', 3 FROM steps WHERE letter <> 's'
    UNION ALL SELECT p, '', p, 'D', 4 FROM range(4) t(p)
),
-- One message after the other: the cheapest way to every place of the pattern.
best(conv, i, place, way) AS (
    SELECT conv, 0::BIGINT, 0::BIGINT, {'cost': 0::BIGINT, 'audit': ''} FROM convs
    UNION ALL
    SELECT b.conv, j.i, e.q::BIGINT,
        min({'cost': b.way.cost + 3 * n.k + e.cost + CASE WHEN j.fault = 3 AND e.edit <> 'D' THEN 3 ELSE 0 END,
             'audit': concat(b.way.audit, repeat('I', n.k), e.edit)})
    FROM best b
    JOIN judged j ON j.conv = b.conv AND j.i = b.i + 1
    JOIN inserts n ON n.p = b.place
    JOIN edits e ON e.p = n.q
        AND (e.edit = 'D' OR j.fault NOT IN (1, 2) AND (e.edit = 'R' OR e.letter = j.initial))
    GROUP BY b.conv, j.i, e.q
),
counts AS (
    SELECT conv, max(i) AS n, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
        count_if(fault = 3) AS truncated,
        count_if(before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
    FROM judged GROUP BY conv
),
ended AS (
    SELECT b.conv, min({'cost': b.way.cost + 3 * k, 'audit': concat(b.way.audit, repeat('I', k))}) AS way
    FROM best b JOIN counts c ON c.conv = b.conv AND c.n = b.i JOIN inserts n ON n.p = b.place AND n.q IN (0, 3)
    GROUP BY b.conv
),
letters AS (
    SELECT conv, pos, edit,
        count_if(edit <> 'I') OVER (PARTITION BY conv ORDER BY pos) AS i,
        count_if(edit <> 'D') OVER (PARTITION BY conv ORDER BY pos) - 1 AS place
    FROM (SELECT conv, unnest(string_split(way.audit, '')) AS edit, generate_subscripts(string_split(way.audit, ''), 1) AS pos FROM ended)
    WHERE edit <> ''
),
written AS (
    SELECT l.conv, l.place, l.edit, j.role, CASE l.edit WHEN 'I' THEN '' ELSE j.text END AS text,
        max(CASE WHEN l.place = 0 AND l.edit = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv) AS shift
    FROM letters l LEFT JOIN judged j ON j.conv = l.conv AND j.i = l.i
    WHERE l.edit <> 'D'
),
repaired AS (
    SELECT conv, string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (place - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END,
        ':', text), chr(10) ORDER BY place) AS lines
    FROM written GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
    coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.cost, 0)::BIGINT AS cost,
    coalesce(way.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM convs LEFT JOIN counts USING (conv) LEFT JOIN ended USING (conv) LEFT JOIN repaired USING (conv)
"""


def _op13(rounds: int = 4) -> str:
    """K-means round by round, every part against every entry."""
    nearest = """
near{n} AS (
    SELECT r, p, min({{'far': far, 'e': e}}) AS best
    FROM (SELECT r, p, e, sum((x - y) * (x - y))::BIGINT AS far FROM parts JOIN book{n} USING (p, j) GROUP BY r, p, e)
    GROUP BY r, p
)"""
    better = """
mean{n} AS (
    SELECT p, best.e AS e, j, sum(x)::BIGINT AS s, count(*) AS c
    FROM near{n} JOIN parts USING (r, p) GROUP BY p, best.e, j
),
book{m} AS (
    SELECT p, e, j, coalesce((s - ((s % c) + c) % c) // c, y) AS y FROM book{n} LEFT JOIN mean{n} USING (p, e, j)
)"""
    steps = []
    for n in range(rounds):
        steps += [nearest.format(n=n), better.format(n=n, m=n + 1)]
    steps.append(nearest.format(n=rounds))
    return f"""
WITH kept AS (
    SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
    FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
    SELECT r, (k - 1) // (n // 4) AS p, (k - 1) % (n // 4) AS j, floor(1024 * x::DOUBLE)::BIGINT AS x
    FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM kept)
),
book0 AS (SELECT p, r - 1 AS e, j, x AS y FROM parts WHERE r <= 256),
{",".join(steps)},
digest AS (SELECT sha256(string_agg(y, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{rounds}),
codes AS (
    SELECT r, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.far)::BIGINT AS error
    FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), digest
"""


def oracle_queries() -> dict[str, str]:
    return {
        "op6_mixing": OP6,
        "op7_secrets": OP7,
        "op10_exact_dedup": OP10,
        "op11_personal_data": OP11,
        "op12_conversations": OP12,
        "op13_vector_codes": _op13(),
    }
