"""DuckDB SQL of the operators that SQL can express, over the view ``documents``."""

from __future__ import annotations


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def _secrets(scope: int = 300) -> str:
    """Parts by marks and running sums of lengths; links by joins of every pair within the scope."""
    named = "[\"'']?\\x20*[:=]\\x20*[\"'']?"
    secret = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
    user = "|".join([f"{_any_case('user')}(?:{_any_case('name')})?", *map(_any_case, ("account", "client_id", "key_id", "login"))])
    kinds = [
        (0, "assign", f"(?:{secret}){named}([A-Za-z0-9+/_.=-]+)", 1, 8, "true"),
        (1, "access", "(AKIA[A-Z0-9]+)", 1, 16, "true"),
        (2, "hex", "([0-9a-f]+)", 1, 32, "true"),
        (3, "key", "([A-Za-z0-9+/]+)", 1, 32, "regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')"),
        (4, "user", f"(?:{user}){named}([A-Za-z0-9_.@-]+)", 1, 4, "true"),
        (5, "endpoint", "(https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\\x00-\\x20\"''<>]*)?)", 1, 12, "true"),
    ]
    found = "\nUNION ALL\n".join(
        f"""SELECT row_id, {n} AS kind, '{name}' AS name, k AS start, k + length(x) AS stop FROM (
  SELECT row_id, x, i, coalesce(sum(length(x)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k
  FROM (SELECT row_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (
    SELECT row_id, string_split(replace(regexp_replace(t, '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(2), chr(1)), chr(1)) AS p FROM d)))
WHERE i % 2 = 0 AND length(regexp_extract(x, '{p}', {g})) >= {least} AND {more}"""
        for n, name, p, g, least, more in kinds
    )
    over = "o.row_id = s.row_id AND o.start < s.stop AND s.start < o.stop"
    near = f"o.row_id = s.row_id AND o.start <= s.stop + {scope} AND s.start <= o.stop + {scope} AND NOT (o.start < s.stop AND s.start < o.stop)"
    by = "ORDER BY start, kind"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
found AS MATERIALIZED ({found}),
base AS (SELECT * FROM found WHERE kind < 3),
loose AS (SELECT * FROM found s WHERE kind = 3 AND NOT EXISTS (FROM base o WHERE {over})),
part AS (SELECT * FROM found WHERE kind <> 3 UNION ALL SELECT * FROM loose),
ids AS (SELECT * FROM part WHERE kind IN (1, 4)),
secrets AS (SELECT * FROM part WHERE kind IN (0, 2, 3)),
linked AS (
  SELECT * FROM part s WHERE kind < 3
    OR (kind IN (3, 5) AND EXISTS (FROM ids o WHERE {near}) AND (kind = 3 OR EXISTS (FROM secrets o WHERE {near})))
    OR (kind = 4 AND EXISTS (FROM secrets o WHERE {near}))),
a AS (SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || start || ':' || stop, ',' {by}) FILTER (kind < 3) AS base, string_agg(name || ':' || start || ':' || stop, ',' {by}) AS spans
  FROM linked GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row_id)"""


def _components(k: int = 5, num: int = 75, den: int = 100) -> str:
    """Sets by lists of words; links by counts of shared shingles of distinct sets; components by reachability."""
    blanks = "[\\x20\\x09-\\x0D]+"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_id, doc_id,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{blanks}'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT row_id, doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) END) AS g FROM d),
sets AS MATERIALIZED (SELECT row_number() OVER (ORDER BY least, g) AS id, g, n, least, copies FROM (SELECT g, len(g) AS n, min(doc_id) AS least, count(*) AS copies FROM s WHERE len(g) > 0 GROUP BY g)),
x AS MATERIALIZED (SELECT id, n, unnest(g) AS h FROM sets),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.h = b.h AND a.id < b.id AND least(a.n, b.n) * {den} >= greatest(a.n, b.n) * {num}
  GROUP BY a.id, b.id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
both_ AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT id, id FROM sets UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON r.other = e.a),
near AS (SELECT e.a AS id, sum(o.copies) AS others FROM both_ e JOIN sets o ON o.id = e.b GROUP BY e.a),
c AS (SELECT r.id, min(o.least) AS component_id FROM reach r JOIN sets o ON o.id = r.other GROUP BY r.id)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
  coalesce(sets.copies - 1 + coalesce(near.others, 0), 0)::BIGINT AS n_links
FROM s LEFT JOIN sets ON sets.g = s.g LEFT JOIN c ON c.id = sets.id LEFT JOIN near ON near.id = sets.id"""


def _repeats() -> str:
    """Windows of 200 bytes as hashes of hexadecimal digits, cut from overlapping blocks of 512 starts."""
    return """
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT row_id, b * 512 AS a, substr(h, b * 1024 + 1, 1024 + 398) AS x FROM (SELECT row_id, h, unnest(range(0, length(h) // 1024 + 1)) AS b FROM d WHERE length(h) >= 400)),
win AS MATERIALIZED (SELECT row_id, a + i AS p, md5(substr(x, i * 2 + 1, 400)) AS w FROM (SELECT row_id, a, x, unnest(range(0, least(512, length(x) // 2 - 199))) AS i FROM block WHERE length(x) >= 400)),
hit AS (SELECT row_id, p FROM (SELECT row_id, p, count(*) OVER (PARTITION BY w) AS c FROM win) WHERE c > 1),
run AS (SELECT row_id, p, p - coalesce(lag(p) OVER (PARTITION BY row_id ORDER BY p), -1000000) > 200 AS first FROM hit),
span AS (SELECT row_id, min(p) AS b, max(p) + 200 AS e FROM (SELECT row_id, p, sum(first::INT) OVER (PARTITION BY row_id ORDER BY p) AS k FROM run) GROUP BY row_id, k),
gap AS (SELECT row_id, coalesce(lag(e) OVER (PARTITION BY row_id ORDER BY b), 0) AS f, b AS t FROM (SELECT row_id, b, e FROM span UNION ALL SELECT row_id, length(h) // 2, length(h) // 2 FROM d)),
kept AS (SELECT row_id, string_agg(substr(h, f * 2 + 1, (t - f) * 2), '' ORDER BY f, t) AS x FROM gap JOIN d USING (row_id) GROUP BY row_id),
n AS (SELECT row_id, count(*) AS n_spans, sum(e - b) AS n_removed FROM span GROUP BY row_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (row_id) LEFT JOIN n USING (row_id)"""


def _mix(entropy: float = 0.98, most_passes: float = 4.0, grid: int = 1 << 20) -> str:
    """The exponent by trying all points of the grid; places by one running sum over a whole pass."""
    sums = "sum(exp(e * ln)) AS z, sum(exp(e * ln) * e * ln) AS s, max(exp((e - 1) * ln)) AS m"
    return f"""
WITH x AS MATERIALIZED (SELECT doc_id, source, greatest(1, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')))::BIGINT AS n FROM documents),
total AS (SELECT sum(n) AS total FROM x),
per AS MATERIALIZED (SELECT source, sum(n)::BIGINT AS tokens, ln(sum(n) / (SELECT total FROM total)::DOUBLE) AS ln FROM x GROUP BY source),
points AS (SELECT e, {sums} FROM (SELECT unnest(range(0, {grid} + 1)) / {grid} AS e) CROSS JOIN per GROUP BY e),
ends AS (SELECT coalesce(max(e) FILTER (ln(z) - s / z >= {entropy} * ln((SELECT count(*) FROM per)) - 1e-12), 0) AS by_entropy,
  coalesce(max(e) FILTER (m / z > {most_passes}), 0) AS by_passes FROM points),
a AS (SELECT greatest(by_entropy, CASE WHEN by_passes > 0 THEN least(1.0, by_passes + 1.0 / {grid}) ELSE 0 END) AS a FROM ends),
w AS (SELECT source, tokens, exp(a * ln) / sum(exp(a * ln)) OVER () AS weight FROM per, a),
goals AS (SELECT *, round(weight * (SELECT total FROM total))::BIGINT AS goal FROM w),
p AS (SELECT x.*, g.weight, g.tokens, g.goal, unnest(range(0, g.goal // g.tokens + 1)) AS pass FROM x JOIN goals g ON x.source IS NOT DISTINCT FROM g.source),
placed AS (SELECT *, pass * tokens + coalesce(sum(n) OVER (PARTITION BY source, pass ORDER BY md5(concat_ws('|', 'mix', pass, doc_id, n)), doc_id::VARCHAR, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM p)
SELECT doc_id, source, n AS n_tokens, pass::INT AS pass, place::BIGINT AS place, round(weight, 12) AS weight FROM placed WHERE place < goal"""


ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": _repeats(), "op4_jaccard_join": _components(), "op5_mixing": _mix(), "op8_secrets": _secrets()}
