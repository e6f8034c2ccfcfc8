"""DuckDB SQL of the operators that SQL can express: other formulations of their results,
run next to the queries on the same tables."""

from __future__ import annotations


def crc32(key: str) -> str:
    """CRC-32 (unsigned) of an ASCII text, bit by bit: a byte is taken in, then eight shifts."""
    shifts = ", ".join(["-1"] * 8)
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({key}) + 1),
  lambda i: [CAST(unicode(substr({key}, CAST(i AS INTEGER), 1)) AS BIGINT), {shifts}]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def periodic_sql() -> str:
    """op11 in SQL: the contract's planting, then every pair of equal words of one document; a run
    is an island of successive words that equal the one q further."""
    crc = crc32("key")
    return f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS given FROM documents),
dice AS (SELECT *, {crc} AS h, len(given) AS n FROM docs),
place AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM dice),
planted AS (SELECT row, doc_id, n, CASE WHEN a IS NULL THEN given ELSE list_transform(range(0, n),
  lambda i: given[CAST(CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END + 1 AS INTEGER)]) END AS words FROM place),
word AS (SELECT row, n, unnest(words) AS w, unnest(range(0, n)) AS i FROM planted),
equal AS (SELECT x.row, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.row = y.row AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS g FROM equal),
long AS (SELECT row, q AS period, min(i) AS start, count(*) + q AS length FROM island GROUP BY row, q, g
  HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.row = r.row AND o.period < r.period
  AND r.period % o.period = 0 AND o.start <= r.start AND o.start + o.length >= r.start + r.length)),
listed AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text,
  list_sort(list({{'e': -(length / period), 's': start, 'q': period, 'l': length}}))[1] AS best FROM runs GROUP BY row),
dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS text FROM (SELECT * FROM word ANTI JOIN dropped USING (row, i)) k GROUP BY row)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length,
 CAST(best.q AS BIGINT) AS period, CAST(best.l * 1000 // best.q AS BIGINT) AS exponent_milli,
 sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed l ON l.row = p.row LEFT JOIN kept k ON k.row = p.row"""


def language_sql(size: int = 400) -> str:
    """op12 in SQL: n-grams by position, profiles by rank, and the mean out-of-place distance."""
    crc = crc32("key")
    return f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, lang, text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
dice AS (SELECT *, {crc} % 3 = 1 AS held_out FROM docs),
plain AS (SELECT *, trim(regexp_replace(lower(text), '[^\\p{{L}}]+', chr(1), 'g'), chr(1)) AS t FROM dice),
texts AS (SELECT row, lang, NOT held_out AND lang IS NOT NULL AS learns, CASE WHEN t <> '' THEN chr(1) || t || chr(1) END AS z FROM plain),
chars AS (SELECT row, lang, learns, unnest(c) AS x, unnest(c[2:]) AS y, unnest(c[3:]) AS w FROM (
  SELECT row, lang, learns, string_split(z, '') AS c FROM texts WHERE z IS NOT NULL) t),
grams AS (SELECT row, lang, learns, unnest(list_filter([CASE WHEN x <> chr(1) THEN x END, x || y, CASE WHEN y <> chr(1) THEN x || y || w END],
  lambda g: g IS NOT NULL)) AS g FROM chars),
sums AS (SELECT lang, g, count(*) AS n FROM grams WHERE learns GROUP BY lang, g),
profiles AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS rank FROM sums) s WHERE rank < {size}),
langs AS (SELECT DISTINCT lang FROM profiles),
own AS (SELECT row, g, count(*) AS n FROM grams GROUP BY row, g),
ranks AS (SELECT row, g, rank() OVER (PARTITION BY row ORDER BY n DESC) - 1 + (count(*) OVER (PARTITION BY row, n) - 1) / 2.0::DOUBLE AS rank,
  row_number() OVER (PARTITION BY row ORDER BY n DESC, length(g), g) AS place FROM own),
dist AS (SELECT r.row, l.lang, sum(least(coalesce(abs(p.rank - r.rank), {size}), {size})) / count(*) / {size}.0::DOUBLE AS d
  FROM ranks r CROSS JOIN langs l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = r.g WHERE r.place <= {size} GROUP BY r.row, l.lang),
best AS (SELECT row, list_sort(list({{'d': d, 'lang': lang}})) AS x FROM dist GROUP BY row)
SELECT doc_id, held_out, coalesce(x[1].lang, 'und') AS lang_pred,
 CASE WHEN x IS NULL THEN 0.0 WHEN len(x) = 1 THEN 1 - x[1].d WHEN x[2].d > 0 THEN 1 - x[1].d / x[2].d ELSE 0.0 END AS score
FROM plain p LEFT JOIN best b ON b.row = p.row"""


def conversation_sql() -> str:
    """op13 in SQL: the contract's damage, then a forward DP over (cost, audit, repaired lines)
    per state, one recursion step a row."""
    crc = crc32("key")
    white = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    add = lambda s, cost, letter, line="": (f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {line}}}" if line
                                            else f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t}}")
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    far = "{'c': 1000000, 'a': '', 't': ''}"

    def closed(p: str) -> str:
        """The states s0..s3 of ``p`` after inserts, as i0..i3."""
        two = least(f"{p}.s2", *[add(f"{p}.s{q}", 2, "I", user) for q in (0, 1, 3)])
        return f"{p}.s0 AS i0, {p}.s1 AS i1, {two} AS i2, {least(f'{p}.s3', add(two, 2, 'I', assistant))} AS i3"

    own, stay = "role || ':' || text || chr(10)", "CAST(coalesce(fault, '') = 'truncated' AS INTEGER)"
    keep = lambda q, initial: f"CASE WHEN sound AND initial = '{initial}' THEN {add(f'i{q}', stay, 'K', own)} ELSE {far} END"
    role = lambda q, r: f"CASE WHEN sound THEN {add(f'i{q}', f'2 + {stay}', 'R', own.replace('role', repr(r), 1))} ELSE {far} END"
    s = [least(add("i0", 3, "D"), keep(0, "")),
         least(add("i1", 3, "D"), keep(0, "s"), keep(1, "")),
         least(add("i2", 3, "D"), *[keep(q, "u") for q in (0, 1, 3)], *[role(q, "user") for q in (0, 1, 3)], keep(2, "")),
         least(add("i3", 3, "D"), keep(2, "a"), role(2, "assistant"), keep(3, ""))]
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
dice AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM dice WHERE kind <> 0),
placed AS (SELECT *, left(role, 1) AS initial, rtrim(text, {white}) AS body,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS rn,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM damaged),
judged AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (rn > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
path AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM counted
  UNION ALL
  SELECT conv_id, rn, {s[0]}, {s[1]}, {s[2]}, {s[3]}
  FROM (SELECT p.conv_id, o.rn, o.role, o.text, o.initial, o.fault, coalesce(o.fault, 'truncated') = 'truncated' AS sound, {closed('p')}
        FROM path p JOIN judged o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.rn = p.i + 1) t),
ends AS (SELECT conv_id, {least('i0', 'i3')} AS best FROM (
  SELECT p.conv_id, {closed('p')} FROM path p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n) t)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.a, '') AS audit, sha256(CASE WHEN coalesce(best.t, '') = '' THEN '' ELSE left(best.t, length(best.t) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
