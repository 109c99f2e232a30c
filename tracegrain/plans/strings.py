"""Queries of the string families and of symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import strings as S
from ..operators import symbols as Y
from . import bindings as B
from .kernels import sql_string_weight, sql_word_weight
from .registry import query

_ORDINARY = r"(regexp_matches({0}, '^\p{{L}}+$') AND ((regexp_matches({0}, '\p{{Ll}}') AND NOT regexp_matches({0}, '[\p{{Lu}}\p{{Lt}}]')) OR regexp_matches({0}, '^[\p{{Lu}}\p{{Lt}}][^\p{{Lu}}\p{{Lt}}]*$')))"
_UNQUOTED = """CASE WHEN starts_with({0}, '"') AND ends_with({0}, '"') THEN substr({0}, 2, greatest(length({0}) - 2, 0)) WHEN starts_with({0}, 'L"') AND ends_with({0}, '"') THEN substr({0}, 3, greatest(length({0}) - 3, 0)) WHEN starts_with({0}, '"') THEN substr({0}, 2) ELSE {0} END"""
#: The index by SQL: post (value, pj, dyn, ver), with both scores.
SQL_INDEX = f"""
post AS (SELECT DISTINCT value, pj, dyn, ver FROM src),
pv AS (SELECT pj, count(DISTINCT ver) AS ver_cnt FROM src GROUP BY pj),
rp AS (SELECT value, count(DISTINCT pj) AS rel FROM post GROUP BY value),
rv AS (SELECT value, pj, dyn, count(*) AS rel_ver FROM post GROUP BY ALL),
wt AS (SELECT value, {sql_string_weight('value')} AS weight FROM rp),
ix AS (SELECT post.*, weight, weight * log10((SELECT count(*) FROM pv) / rel) AS pj_score, weight * log10(ver_cnt / rel_ver) AS ver_score
  FROM post JOIN rp USING (value) JOIN wt USING (value) JOIN rv USING (value, pj, dyn) JOIN pv USING (pj)),
tot AS (SELECT pj, dyn, ver, sum(pj_score) AS total_pj_score, sum(ver_score) AS total_ver_score, count(*) AS total_count FROM ix GROUP BY ALL),
hit AS (SELECT * FROM (SELECT DISTINCT bin_file, value FROM bin WHERE length(value) BETWEEN 1 AND 65535) JOIN ix USING (value)),
sc AS (SELECT bin_file, pj, dyn, ver, sum(pj_score) AS pj_score, sum(ver_score) AS ver_score, count(*) AS matched_count FROM hit GROUP BY ALL),
cand AS (SELECT *, matched_count / total_count AS count_sim, pj_score / total_pj_score AS score_sim FROM sc JOIN tot USING (pj, dyn, ver) WHERE total_pj_score <> 0 AND total_count > 20
  AND (matched_count / total_count >= 0.5 OR pj_score / total_pj_score >= 0.5 OR (matched_count / total_count >= 0.3 AND pj_score / total_pj_score >= 0.3)
    OR (total_count > 500 AND matched_count / total_count + pj_score / total_pj_score >= 0.5)))
"""
_WITH = f"WITH {B.SQL_WORDS}, {SQL_INDEX}"


def index_of(spark, d):
    source = B.source_strings(spark, d)
    return S.string_index(source, source.select("pj", "ver"))


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("controller", f"WITH {B.SQL_WORDS} SELECT pj, count(DISTINCT ver) AS ver_cnt FROM src GROUP BY pj")
def controller(spark, d):
    return S.version_counts(B.source_strings(spark, d))


@query("postings_build", f"WITH {B.SQL_WORDS} SELECT value, count(DISTINCT pj) AS projects, count(DISTINCT pj || ':' || dyn) AS dyns, count(DISTINCT pj || ':' || dyn || ':' || ver) AS postings FROM src GROUP BY value")
def postings_build(spark, d):
    post = B.source_strings(spark, d).distinct()
    return post.groupBy("value").agg(F.size(F.collect_set("pj")).cast("long").alias("projects"), F.size(F.collect_set(F.struct("pj", "dyn"))).cast("long").alias("dyns"), F.count("*").alias("postings"))


@query("idf_scores", f"{_WITH} SELECT value, pj, dyn, ver, round(weight, 6) AS weight, round(pj_score, 6) AS pj_score, round(ver_score, 6) AS ver_score FROM ix")
def idf_scores(spark, d):
    return index_of(spark, d).select("value", "pj", "dyn", "ver", *_r("weight", "pj_score", "ver_score"))


@query("string_totals", f"{_WITH} SELECT pj, dyn, ver, round(total_pj_score, 6) AS total_pj_score, round(total_ver_score, 6) AS total_ver_score, total_count FROM tot")
def string_totals(spark, d):
    return S.score_totals(index_of(spark, d)).select("pj", "dyn", "ver", *_r("total_pj_score", "total_ver_score"), "total_count")


def candidates_of(spark, d):
    index = index_of(spark, d)
    return S.string_candidates(S.score_tables(S.probe(index, B.binary_strings(spark, d))), S.score_totals(index))


@query("string_match_index", f"{_WITH} SELECT bin_file, pj, dyn, ver, matched_count, total_count, round(count_sim, 6) AS count_sim, round(score_sim, 6) AS score_sim FROM cand")
def string_match_index(spark, d):
    return candidates_of(spark, d).select("bin_file", "pj", "dyn", "ver", "matched_count", "total_count", *_r("count_sim", "score_sim"))


@query("score_tables", f"{_WITH} SELECT bin_file, pj, dyn, ver, round(pj_score, 6) AS pj_score, round(ver_score, 6) AS ver_score, matched_count FROM sc")
def score_tables(spark, d):
    return S.score_tables(S.probe(index_of(spark, d), B.binary_strings(spark, d))).select("bin_file", "pj", "dyn", "ver", *_r("pj_score", "ver_score"), "matched_count")


@query("string_normalize", f"WITH {B.SQL_WORDS} SELECT bin_file, value, count(*) AS n FROM bin WHERE NOT starts_with(value, '?') AND NOT starts_with(value, '.?') AND NOT {_ORDINARY.format('value')} GROUP BY ALL")
def string_normalize(spark, d):
    return S.binary_side(B.binary_strings(spark, d)).groupBy("bin_file", "value").agg(F.count("*").alias("n"))


#: Pairs by strings: m (pj, dyn, bin_file, c, weights) with the totals t (pj, dyn, n, w).
SQL_PAIRWISE = f"""u AS (SELECT pj, dyn, {_UNQUOTED.format('value')} AS value FROM src), lib AS (SELECT DISTINCT pj, dyn, value FROM u WHERE NOT {_ORDINARY.format('value')}),
  lw AS (SELECT *, CASE WHEN contains(value, ' ') THEN NULL ELSE {sql_word_weight('value', 'pj')} END AS weight FROM lib),
  t AS (SELECT pj, dyn, count(*) AS n, sum(weight) AS w FROM lw GROUP BY ALL), b AS (SELECT * FROM bin WHERE NOT starts_with(value, '?') AND NOT starts_with(value, '.?') AND NOT {_ORDINARY.format('value')}),
  m AS (SELECT pj, dyn, bin_file, count(*) AS c, sum(weight) AS weights FROM lw JOIN b USING (value) GROUP BY ALL)"""


@query("string_match_pairwise", f"""WITH {B.SQL_WORDS}, {SQL_PAIRWISE}
  SELECT pj, dyn, bin_file, round(c / n, 6) AS percent, round(weights, 6) AS weights, round(weights / w, 6) AS weight_percent, c / n > 0.5 OR (weights > 100 AND weights / w > 0.1) AS matched FROM m JOIN t USING (pj, dyn)""")
def string_match_pairwise(spark, d):
    out = S.match_pairwise(B.source_strings(spark, d), B.binary_strings(spark, d))
    return out.select("pj", "dyn", "bin_file", *_r("percent", "weights", "weight_percent"), "matched")


@query("string_array_match", f"""WITH {B.SQL_WORDS}, lns AS (SELECT doc_id, source AS pj, lang AS dyn, generate_subscripts(string_split(text, chr(10)), 1) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents WHERE (doc_id // 20) % 5 <> 0),
  a AS (SELECT doc_id, ln, pj, dyn, [{_UNQUOTED.format('x')} for x in string_split(line, ' ')] AS arr FROM lns), l AS (SELECT * FROM a WHERE len(arr) >= 3),
  t AS (SELECT pj, dyn, count(*) AS arrays, sum(len(arr)) AS items, sum(list_sum([length(x) for x in arr])) AS chars FROM l GROUP BY ALL),
  i AS (SELECT doc_id, ln, pj, dyn, len(arr) AS n, unnest(list_distinct(arr)) AS value FROM l), bd AS (SELECT DISTINCT bin_file, value FROM bin),
  e AS (SELECT doc_id, ln, pj, dyn, n, bin_file, count(*) AS hit, sum(length(value)) AS hc FROM i JOIN bd USING (value) GROUP BY ALL),
  f AS (SELECT pj, dyn, bin_file, count(*) FILTER (hit / n >= 0.8) AS ha, sum(hit) AS hs, sum(hc) AS hc FROM e GROUP BY ALL)
  SELECT pj, dyn, bin_file, round(ha / arrays, 6) AS array_percent, round(hs / items, 6) AS string_percent, round(hc / chars, 6) AS char_percent, CAST(hs AS BIGINT) AS matched_strings,
    ha / arrays >= 0.5 OR greatest(hs / items, hc / chars) >= 0.6 AS matched FROM f JOIN t USING (pj, dyn)""")
def string_array_match(spark, d):
    docs = B.table(spark, d, "documents").where("(doc_id div 20) % 5 <> 0").select("doc_id", F.col("source").alias("pj"), F.col("lang").alias("dyn"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    arrays = docs.select(F.struct("doc_id", "at").alias("id"), "pj", "dyn", F.split("line", " ", -1).alias("arr"))
    out = S.match_string_arrays(arrays, B.binary_strings(spark, d))
    return out.select("pj", "dyn", "bin_file", *_r("array_percent", "string_percent", "char_percent"), "matched_strings", "matched")


_EXPORTS = """ns AS (SELECT lib, count(*) AS ns FROM sexp GROUP BY lib), nb AS (SELECT bin_file, count(*) AS nb FROM bexp GROUP BY bin_file),
  sh AS (SELECT lib, bin_file, count(*) AS score FROM (SELECT DISTINCT * FROM sexp) JOIN (SELECT DISTINCT * FROM bexp) USING (name) GROUP BY ALL),
  em AS (SELECT lib, bin_file, score, ns, score / ns AS similarity, (ns > 5 AND score / ns >= 0.8) OR score > 20 OR (ns > 10 AND score / nb + score / ns >= 1.2) OR score / nb + score / ns >= 1.5 AS matched
    FROM sh JOIN ns USING (lib) JOIN nb USING (bin_file))"""


@query("export_match", f"WITH {B.SQL_SYMBOLS}, {_EXPORTS} SELECT lib, bin_file, round(similarity, 6) AS similarity, score, matched FROM em")
def export_match(spark, d):
    return Y.match_exports(B.source_symbols(spark, d), B.binary_symbols(spark, d)).select("lib", "bin_file", *_r("similarity"), "score", "matched")


@query("funcname_match", """WITH sf AS (SELECT DISTINCT p_type AS lib, 'core::' || p_name || '(int a)' AS name FROM part), bx AS (SELECT p_brand AS bin_file, 'x::' || p_name AS name FROM part),
  nb AS (SELECT bin_file, count(*) AS exports FROM bx GROUP BY 1 HAVING count(*) > 10), s AS (SELECT DISTINCT lib, string_split(string_split(name, '::')[-1], '(')[1] AS k FROM sf),
  b AS (SELECT DISTINCT bin_file, string_split(name, '::')[-1] AS k FROM bx JOIN nb USING (bin_file)), t AS (SELECT bin_file, count(*) AS names FROM b GROUP BY 1),
  f AS (SELECT lib, bin_file, count(*) AS n FROM s JOIN b USING (k) GROUP BY ALL)
  SELECT lib, bin_file, CASE WHEN n / names > 0.8 THEN round(n / names, 6) ELSE 0 END AS similarity, CASE WHEN n / names > 0.8 THEN n ELSE 0 END AS score, n / names > 0.8 AS matched FROM f JOIN t USING (bin_file)""")
def funcname_match(spark, d):
    part = B.table(spark, d, "part")
    source = part.selectExpr("p_type AS lib", "concat('core::', p_name, '(int a)') AS name").distinct()
    binary = part.selectExpr("p_brand AS bin_file", "concat('x::', p_name) AS name")
    return Y.match_function_names(source, binary).select("lib", "bin_file", *_r("similarity"), F.col("score").cast("long").alias("score"), "matched")


_EXPORTED = "SELECT DISTINCT p_type AS lib, 'e' || p_name AS name FROM part WHERE p_type = 'SMALL' OR (p_type = 'PROMO' AND p_partkey <= 30)"


@query("funcname_gate", f"""WITH sf AS (SELECT DISTINCT p_type AS lib, 'core::' || p_name || '(int a)' AS name FROM part), se AS ({_EXPORTED}),
  bx AS (SELECT p_brand AS bin_file, 'x::' || p_name AS name FROM part UNION ALL SELECT p_brand, 'e' || p_name FROM part WHERE p_size <= 25),
  nx AS (SELECT bin_file, count(*) AS exports FROM bx GROUP BY 1), s AS (SELECT DISTINCT lib, string_split(string_split(name, '::')[-1], '(')[1] AS k FROM sf),
  b AS (SELECT DISTINCT bin_file, string_split(name, '::')[-1] AS k FROM bx JOIN nx USING (bin_file) WHERE exports > 10), t AS (SELECT bin_file, count(*) AS names FROM b GROUP BY 1),
  f AS (SELECT lib, bin_file, count(*) AS n FROM s JOIN b USING (k) GROUP BY ALL), ns AS (SELECT lib, count(*) AS ns FROM se GROUP BY 1),
  sh AS (SELECT lib, bin_file, count(*) AS score FROM se JOIN (SELECT DISTINCT * FROM bx) USING (name) GROUP BY ALL),
  em AS (SELECT lib, bin_file FROM sh JOIN ns USING (lib) JOIN nx USING (bin_file) WHERE (ns > 5 AND score / ns >= 0.8) OR score > 20 OR (ns > 10 AND score / exports + score / ns >= 1.2) OR score / exports + score / ns >= 1.5)
  SELECT lib, bin_file, CASE WHEN n / names > 0.8 THEN round(n / names, 6) ELSE 0 END AS similarity, CASE WHEN n / names > 0.8 THEN n ELSE 0 END AS score, n / names > 0.8 AS matched FROM f JOIN t USING (bin_file)
  WHERE lib NOT IN (SELECT lib FROM ns WHERE ns > 5) AND (lib, bin_file) NOT IN (SELECT (lib, bin_file) FROM em)""")
def funcname_gate(spark, d):
    """Function names, where exports decide nothing: libraries of at most five exports, pairs whose exports did not match."""
    part = B.table(spark, d, "part")
    source = part.selectExpr("p_type AS lib", "concat('core::', p_name, '(int a)') AS name").distinct()
    exported = part.where("p_type = 'SMALL' OR (p_type = 'PROMO' AND p_partkey <= 30)").selectExpr("p_type AS lib", "concat('e', p_name) AS name").distinct()
    binary = part.selectExpr("p_brand AS bin_file", "concat('x::', p_name) AS name").union(part.where("p_size <= 25").selectExpr("p_brand AS bin_file", "concat('e', p_name) AS name"))
    return Y.match_function_names(source, binary, exported).select("lib", "bin_file", *_r("similarity"), F.col("score").cast("long").alias("score"), "matched")


@query("signature_match", """WITH sf AS (SELECT DISTINCT p_type AS lib, replace(p_name, ' ', '_') AS k, p_size % 4 AS v FROM part), bx AS (SELECT DISTINCT p_brand AS bin_file, replace(p_name, ' ', '_') AS k, p_size % 3 AS v FROM part),
  s AS (SELECT lib, k, CASE v WHEN 0 THEN 'int,*' WHEN 1 THEN 'const char *' WHEN 2 THEN 'void' ELSE 'foo *' END AS parameters FROM sf),
  b AS (SELECT bin_file, k, CASE v WHEN 0 THEN 'const char *' WHEN 1 THEN 'void' ELSE '* foo' END AS parameters FROM bx)
  SELECT lib, bin_file, k AS name, max(parameters) AS parameters FROM (SELECT lib, k, CASE WHEN parameters = 'foo *' THEN '* foo' ELSE parameters END AS parameters FROM s) JOIN b USING (k, parameters) GROUP BY ALL""")
def signature_match(spark, d):
    part = B.table(spark, d, "part")
    key = "replace(p_name, ' ', '_')"
    source = part.selectExpr("p_type AS lib", f"concat({key}, CASE p_size % 4 WHEN 0 THEN '(int a,*p)' WHEN 1 THEN '(const char *name)' WHEN 2 THEN '()' ELSE '(foo *p)' END) AS name").distinct()
    binary = part.selectExpr("p_brand AS bin_file", f"concat({key}, CASE p_size % 3 WHEN 0 THEN '(char const *)' WHEN 1 THEN '()' ELSE '(class foo *)' END) AS name")
    return Y.match_signatures(source, binary)
