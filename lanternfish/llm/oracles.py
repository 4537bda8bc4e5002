"""SQL that gives the same rows as the queries, for DuckDB, where SQL can express them on whole tables."""

from __future__ import annotations

import string

_LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    """Words between white space, as a list without empty parts."""
    return rf"list_filter(string_split_regex(coalesce({text}, ''), '{_SPACE}'), lambda x: x <> '')"


QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1) GROUP BY 1),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(l) AS n_lines, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters, len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_shouted FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words) OR 2 * n_letters < word_chars OR 2 * n_shouted > n_words) AS kept
FROM v"""


def chat_sql(part_bytes: int = 1 << 22, context_turns: int = 16) -> str:
    return rf"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER w - 1 AS place, sum(strlen(role) + strlen(text) + 32) OVER w - strlen(role) - strlen(text) - 32 AS bytes_before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
n AS (SELECT conv_id, sum(strlen(role) + strlen(text) + 32) AS n_bytes FROM t GROUP BY 1),
q AS (SELECT *, CASE WHEN n_bytes > {part_bytes} THEN bytes_before // {part_bytes} ELSE 0 END AS cut, min(CASE WHEN role <> 'system' THEN place END) OVER (PARTITION BY conv_id) AS speaks FROM r JOIN n USING (conv_id)),
p AS (SELECT conv_id, role, text, place, speaks, dense_rank() OVER (PARTITION BY conv_id ORDER BY cut) - 1 AS part, max(place) OVER (PARTITION BY conv_id, cut) AS last FROM q),
s AS (SELECT DISTINCT conv_id, part, role AS perspective FROM p WHERE role <> 'system'),
a AS (SELECT conv_id, part, place, role, text, false AS again FROM p UNION ALL
  SELECT x.conv_id, s.part, place, role, text, true FROM p x JOIN (SELECT DISTINCT conv_id, part FROM s) s ON s.conv_id = x.conv_id
  WHERE s.part > 0 AND (x.part = 0 AND place < speaks OR x.part = s.part - 1 AND place > last - {context_turns})),
v AS (SELECT conv_id, part, perspective, place, again, role = perspective AND NOT again AS target,
  CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM a JOIN s USING (conv_id, part)),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM v)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (again) AS n_repeated, count(*) FILTER (target) AS n_targets, sha256(string_agg(head || body, '' ORDER BY place)) AS text_sha256,
  coalesce(string_agg((upto - length(body))::BIGINT || ':' || (upto - 1)::BIGINT, ',' ORDER BY place) FILTER (target), '') AS mask
FROM o GROUP BY 1, 2, 3"""


_LINKED = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {{percent}} * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)"""

JACCARD = _LINKED.format(percent=80)

MINHASH = f"SELECT *, doc_id = component_id AS kept FROM ({_LINKED.format(percent=85)})"


def _clusters(clusters: int = 8, rounds: int = 10) -> str:
    """Each round is a pair of tables: where vectors belong, and the centroids after that."""
    ctes = [
        "v AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS k, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM v)",
        f"s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, vec_id FROM v ORDER BY 1 LIMIT {clusters})",
        "c0 AS MATERIALIZED (SELECT cluster, k, x AS c FROM s JOIN x USING (vec_id))",
    ]
    for r in range(rounds + 1):
        distances = f"SELECT vec_id, cluster, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (k) GROUP BY 1, 2"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, min((d, cluster)) AS best FROM ({distances}) GROUP BY 1)")
        if r < rounds:
            sums = f"SELECT best[2] AS cluster, k, sum(x)::BIGINT AS t, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY 1, 2"
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, k, (t - ((t % n) + n) % n) // n AS c FROM ({sums}) UNION ALL SELECT cluster, k, c FROM c{r} WHERE cluster NOT IN (SELECT best[2] FROM a{r}))")
    digests = f"SELECT cluster, sha256(string_agg(c, ',' ORDER BY k)) AS centroid_sha256 FROM c{rounds} GROUP BY 1"
    return f"""WITH {(","+chr(10)).join(ctes)},
r AS (SELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM r JOIN ({digests}) USING (cluster)"""


PHRASES = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
f AS (SELECT lang, m, p, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS p FROM w, range(1, 5) r(m)) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, m, p, string_split(p, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, p, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.p, k.a, min((2000000 * k.a::HUGEINT // (x.f + y.f), k.k, x.f, y.f)) AS best FROM k JOIN f x ON x.lang = k.lang AND x.p = k.x JOIN f y ON y.lang = k.lang AND y.p = k.y GROUP BY 1, 2, 3),
h AS (SELECT lang, array_to_string(w[i:j], ' ') AS p, max(a) AS longest FROM c, range(1, 5) u(i), range(1, 5) v(j) WHERE i < j AND j <= m AND j - i + 1 < m GROUP BY 1, 2),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY best[1] DESC, a DESC, p) AS rank, p AS phrase, a, best[3]::BIGINT AS l, best[4]::BIGINT AS r, n::BIGINT AS n, best[1]::BIGINT AS score
  FROM s JOIN n USING (lang) LEFT JOIN h USING (lang, p) WHERE longest IS NULL OR 100 * longest::HUGEINT < 80 * a)
SELECT * FROM r WHERE rank <= 2000"""

ORACLE_SQL = {
    "op4_quality_rules": QUALITY,
    "op9_chat_rotation": chat_sql(),
    "op10_jaccard_join": JACCARD,
    "op11_minhash": MINHASH,
    "op12_phrase_mining": PHRASES,
    "op13_centroid_clustering": _clusters(),
}
