"""DuckDB SQL for the queries that SQL can express whole."""

from __future__ import annotations

import string

from .mixing import BLOCK, EACH, SLOTS
from .quality import LEFT, LIMIT
from .suffix_dedup import LENGTH, PASSAGE, WORDS

_LOWER = f"translate({{0}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"[x for x in regexp_split_to_array({0}, '[\x20\x09-\x0D]+') if x <> '']"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, host, text, {_WORDS.format('text')} AS w FROM d),
t AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM t),
rw AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) v(o) WHERE k > 1 GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, host, line, {_WORDS.format(_LOWER.format('line'))} AS w FROM l),
dl AS (SELECT doc_id, sum(k - 1) AS n FROM (SELECT doc_id, line, count(*) AS k FROM lw WHERE len(w) > 0 GROUP BY ALL) GROUP BY doc_id),
nl AS (SELECT doc_id, host, regexp_replace(array_to_string(w, ' '), '[0-9]+', '0', 'g') AS key, len(w) AS words FROM lw WHERE len(w) > 0),
fr AS (SELECT host, key FROM nl GROUP BY ALL HAVING count(DISTINCT doc_id) > {LIMIT}),
rm AS (SELECT doc_id, sum(words) AS n FROM nl JOIN fr USING (host, key) GROUP BY doc_id),
a AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines,
  coalesce(rw.n, 0) AS n_repeat_words, coalesce(rm.n, 0) AS n_removed_words FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {LEFT} * n_words AS kept, CAST(n_removed_words AS BIGINT) AS n_removed_words FROM a
"""

OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings WHERE label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN r ON r.id = vec_id GROUP BY vec_id
"""

_WHITE = "('09', '0A', '0B', '0C', '0D', '20')"


def _runs(length: int, name: str) -> str:
    """Maximal runs (doc_id, lo, hi) of strings of ``length`` bytes that start at two places and more."""
    return f"""{name}w AS (SELECT doc_id, i, hash(array_slice(b, i, i + {length - 1})) AS h FROM (SELECT doc_id, b, unnest(range(1, n - {length} + 2)) AS i FROM d)),
{name}s AS (SELECT doc_id, i FROM {name}w WHERE h IN (SELECT h FROM {name}w GROUP BY h HAVING count(*) > 1)),
{name}e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {length}, true) AS first FROM {name}s),
{name} AS (SELECT doc_id, min(i) - 1 AS lo, max(i) - 1 + {length} AS hi FROM (SELECT *, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM {name}e) GROUP BY doc_id, k)"""


OP10 = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents), {_runs(LENGTH, 'r')}, {_runs(PASSAGE, 'q')},
k AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM (SELECT doc_id, lo, hi FROM r UNION ALL SELECT doc_id, n, n FROM d)),
t AS (SELECT doc_id, string_agg(substr(hex(b), 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo, since) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed FROM r GROUP BY doc_id),
x AS (SELECT doc_id, hi - lo AS size, hex(array_slice(b, lo + 1, hi)) AS h FROM q JOIN d USING (doc_id)),
p AS (SELECT doc_id, sum(size) AS n_passage FROM x WHERE size >= {LENGTH} OR len([1 for i in range(1, size + 1) if substr(h, 2 * i - 1, 2) NOT IN {_WHITE} AND (i = 1 OR substr(h, 2 * i - 3, 2) IN {_WHITE})]) >= {WORDS} GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256, CAST(coalesce(n_passage, 0) AS BIGINT) AS n_passage
FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS s FROM documents), z AS (SELECT s, sqrt(count(*)) AS x FROM d GROUP BY s),
h AS (SELECT s, x / (SELECT sum(x) FROM z) * greatest({SLOTS}, {EACH} * (SELECT count(*) FROM z)) AS share FROM z),
f AS (SELECT s, greatest(1, CAST(floor(share) AS BIGINT)) AS w, row_number() OVER (ORDER BY floor(share) - share, s) AS k FROM h),
w AS (SELECT s, w + CASE WHEN k <= greatest({SLOTS}, {EACH} * (SELECT count(*) FROM f)) - (SELECT sum(w) FROM f) THEN 1 ELSE 0 END AS w FROM f),
a AS (SELECT list(s ORDER BY s) AS names, list(w ORDER BY s) AS w, CAST(sum(w) AS BIGINT) AS slots, count(*) AS n FROM w),
e(t, g, i) AS (SELECT CAST(-1 AS BIGINT), [CAST(0 AS BIGINT) for x in w], CAST(0 AS BIGINT) FROM a UNION ALL
  SELECT t + 1, [CASE WHEN k = b THEN g[k] + 1 ELSE g[k] END for k in range(1, n + 1)], b FROM (SELECT t, g, n,
    list_sort([{{'due': ((g[k] + 1) * slots + w[k] - 1) // w[k], 'over': CASE WHEN (g[k] + 1) * slots % w[k] = 0 THEN 1 ELSE 0 END, 'light': -w[k], 'k': k}} for k in range(1, n + 1) if g[k] < w[k] AND g[k] * slots // w[k] <= t + 1])[1].k AS b
    FROM e, a WHERE t + 1 < slots)),
p AS (SELECT names[i] AS s, t AS slot, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS j FROM e, a WHERE t >= 0),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM d)
SELECT r.doc_id, o.source, rank // {BLOCK} AS block, rank // {BLOCK} // w.w * (SELECT slots FROM a) + p.slot AS slot, CAST(rank % {BLOCK} AS INT) AS place
FROM r JOIN w USING (s) JOIN p ON p.s = r.s AND p.j = rank // {BLOCK} % w.w JOIN documents o ON o.doc_id = r.doc_id
"""

ORACLE = {"op4_mixing": OP4, "op10_suffix_dedup": OP10, "op1_minhash": OP1, "op3_quality": OP3, "op5_vector_graph": OP5}
