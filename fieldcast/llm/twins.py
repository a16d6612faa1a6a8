"""SQL of the queries whose twins are long."""

from __future__ import annotations

_BLANK = r"[^\x20\x09-\x0D]"


def _step() -> str:
    """Best (cost, audit, text) of every state before a row, from those after it; candidates in the order D, K, R, then insertions."""
    gives, after = {0: "user", 1: "user", 2: "assistant", 3: "user"}, {0: 2, 1: 2, 2: 3, 3: 2}
    says = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    base = []
    for q in range(4):
        stay = f"{{'c': v{q}.c + 2, 's': 'D' || v{q}.s, 'r': v{q}.r}}"
        given = f"{{'c': v{after[q]}.c + 1 + late, 's': 'R' || v{after[q]}.s, 'r': chr(10) || '{gives[q]}:' || text || v{after[q]}.r}}"
        kept = "".join(f" WHEN initial = '{i}' THEN {{'c': v{t}.c + late, 's': 'K' || v{t}.s, 'r': chr(10) || role || ':' || text || v{t}.r}}" for i, t in says[q].items())
        base.append(f"CASE WHEN gone THEN {stay} ELSE least({stay}, {given}, CASE{kept} ELSE {given} END) END AS b{q}")
    return ", ".join(base)


def _insert(q: int, after: str) -> str:
    role = "assistant" if q == 2 else "user"
    return f"{{'c': {after}.c + 5, 's': 'I' || {after}.s, 'r': chr(10) || '{role}:' || {after}.r}}"


def _ends() -> str:
    said = {0: (0, "", ""), 1: (10, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'"), 2: (5, "I", "chr(10) || 'assistant:'"), 3: (0, "", "")}
    return ", ".join(f"{{'c': {c}::BIGINT, 's': '{s}', 'r': {r or chr(39) * 2}}} AS v{q}" for q, (c, s, r) in said.items())


CONVERSATIONS = rf"""
WITH RECURSIVE dealt AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT),
            lambda crc, byte: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, xor(crc, byte)),
            4294967295::BIGINT), 4294967295::BIGINT) % 20 AS deal
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
        CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM dealt, unnest(range(CASE deal WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS place, left(role, 1) AS initial,
        NOT regexp_matches(text, '{_BLANK}') AS blank,
        right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS open_end
    FROM damaged
), seen AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again FROM numbered
), marked AS (
    SELECT *, blank OR again AS gone, CASE WHEN open_end AND NOT blank AND NOT again THEN 5 ELSE 0 END AS late,
        (lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial) NOT IN ('su', 'ua', 'au') AS clash
    FROM seen
), totals AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (late > 0) AS truncated, count(*) FILTER (clash) AS illegal
    FROM marked GROUP BY conv_id
), back AS (
    SELECT conv_id, n + 1 AS place, {_ends()} FROM totals
    UNION ALL
    SELECT conv_id, place, least(b0, {_insert(0, "w2")}), least(b1, {_insert(1, "w2")}), w2, least(b3, {_insert(3, "b2")})
    FROM (
        SELECT *, least(b2, {_insert(2, "b3")}) AS w2 FROM (
            SELECT back.conv_id, marked.place, {_step()}
            FROM back JOIN marked ON marked.conv_id IS NOT DISTINCT FROM back.conv_id AND marked.place = back.place - 1
        )
    )
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.s, '') AS audit, sha256(coalesce(substr(v0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN totals ON totals.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back ON back.conv_id IS NOT DISTINCT FROM o.conv_id AND back.place = 1
"""

FILTERS = r"""
WITH rows_of AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), first_of AS (
    SELECT body, min(doc_id) AS smallest FROM rows_of GROUP BY body
), judged AS (
    SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d, coalesce(doc_id > smallest, false) AS e
    FROM rows_of JOIN first_of USING (body)
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), counted AS (
    SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM judged LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT f.letter || g.letter || h.letter || i.letter || j.letter AS filter_order, [f.bit, g.bit, h.bit, i.bit, j.bit] AS bits
    FROM letters f, letters g, letters h, letters i, letters j WHERE f.bit + g.bit + h.bit + i.bit + j.bit = 31 AND (f.bit | g.bit | h.bit | i.bit | j.bit) = 31
), steps AS (
    SELECT filter_order, s::INT AS step, bits[s] AS bit, list_sum(bits[1:s])::INT - bits[s] AS before FROM orders, range(1, 6) t(s)
), edges AS (
    SELECT part, bit, before, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
        sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
    FROM counted, (SELECT DISTINCT bit, before FROM steps) GROUP BY part, bit, before
), shares AS (
    SELECT part, bit, sum(removed) AS shapley FROM edges JOIN steps USING (bit, before) GROUP BY part, bit
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(shapley, 0)::BIGINT AS shapley
FROM steps JOIN edges USING (bit, before) JOIN shares USING (part, bit)
"""
