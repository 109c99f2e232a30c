"""Queries from candidates to verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import strings as S
from ..operators import verdicts as V
from . import bindings as B
from .arrays import _BYTES, _INDEX, _RULE, _SEARCH
from .arrays import index_of as arrays_of
from .arrays import orders_of, segments_of
from ..staging import staged
from .registry import query
from .strings import _WITH, candidates_of, index_of, _r
from ..operators import arrays as A

_ALIAS = [("src1", "en", "alpha"), ("src2", "", "beta"), ("src3", "", ""), ("src4", "fr", None), ("src5", "en", "")]
_SQL_ALIAS = "al AS (SELECT * FROM (VALUES ('src1', 'en', 'alpha'), ('src2', '', 'beta'), ('src3', '', ''), ('src4', 'fr', NULL), ('src5', 'en', '')) v(pj, dyn, alias_pj))"
_FOLD = "CASE WHEN coalesce(o.alias_pj, '') <> '' THEN o.alias_pj ELSE coalesce(g.alias_pj, s.pj) END"


def alias_of(spark):
    return spark.createDataFrame(_ALIAS, "pj string, dyn string, alias_pj string")


@query("alias_fold", f"""WITH {B.SQL_WORDS}, {_SQL_ALIAS}, s AS (SELECT DISTINCT pj, dyn FROM src) SELECT s.pj, s.dyn, {_FOLD} AS name FROM s LEFT JOIN al o ON o.pj = s.pj AND o.dyn = s.dyn LEFT JOIN al g ON g.pj = s.pj AND g.dyn = ''
  WHERE coalesce(o.alias_pj, '') <> '' OR g.alias_pj IS NULL OR g.alias_pj <> ''""")
def alias_fold(spark, d):
    return V.folded_aliases(B.source_strings(spark, d).select("pj", "dyn").distinct(), alias_of(spark))


@query("invalid_filter", f"WITH {B.SQL_WORDS} SELECT DISTINCT pj, dyn FROM src WHERE pj NOT IN ('src6', 'src7') AND NOT (pj = 'src8' AND dyn = 'en')")
def invalid_filter(spark, d):
    invalid = spark.createDataFrame([("src6", "", "array"), ("src7", "", ""), ("src8", "en", "array"), ("src9", "", "string")], "pj string, dyn string, family string")
    return V.without_invalid(B.source_strings(spark, d).select("pj", "dyn").distinct(), invalid, "array")


@query("pair_overlap", f"""{_WITH}, m AS (SELECT DISTINCT bin_file, pj, dyn, ver, value FROM hit SEMI JOIN cand USING (bin_file, pj, dyn, ver))
  SELECT bin_file, concat_ws(':', a.pj, a.dyn, a.ver) AS a, concat_ws(':', b.pj, b.dyn, b.ver) AS b, count(*) AS overlap FROM m a JOIN m b USING (bin_file, value) WHERE (a.pj, a.dyn, a.ver) < (b.pj, b.dyn, b.ver) GROUP BY ALL""")
def pair_overlap(spark, d):
    keys = ["pj", "dyn", "ver"]
    hits = S.probe(index_of(spark, d), B.binary_strings(spark, d)).join(candidates_of(spark, d).select("bin_file", *keys), ["bin_file", *keys], "left_semi")
    name = lambda k: F.concat_ws(":", *(F.col(f"{k}.{c}") for c in keys)).alias(k)
    return V.pair_overlap(hits, "bin_file", keys, "value").select("bin_file", name("a"), name("b"), "overlap")


def sql_greedy(strings: bool) -> str:
    """k2 (bin_file, pj, dyn, ver): what two greedy passes leave of cd (with mc, tc) by the items it (with value)."""
    first = "n / b.mc >= 0.85 AND n * 1.3 <= a.mc" if strings else "n / b.mc > 0.85 AND n * 1.3 < a.mc"
    second = "n / a.mc >= 0.85 AND b.tc / a.tc >= 1.3" if strings else "n / a.mc > 0.85 AND b.tc / a.tc < 1.3"

    def one(k: int, rows: str, order: str, gone: str) -> str:
        return f"""o{k} AS (SELECT *, row_number() OVER (PARTITION BY bin_file ORDER BY {order}, pj, dyn, ver) AS i FROM {rows}),
  v{k} AS (SELECT bin_file, value, i FROM it JOIN o{k} USING (bin_file, pj, dyn, ver)), n{k} AS (SELECT bin_file, a.i AS ai, b.i AS bi, count(*) AS n FROM v{k} a JOIN v{k} b USING (bin_file, value) WHERE a.i < b.i GROUP BY ALL),
  x{k} AS (SELECT bin_file, bi, list(ai) AS killers FROM n{k} JOIN o{k} a USING (bin_file) JOIN o{k} b USING (bin_file) WHERE a.i = ai AND b.i = bi AND {gone} GROUP BY ALL),
  r{k}(bin_file, i, kept) AS (SELECT DISTINCT bin_file, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM o{k} UNION ALL SELECT o.bin_file, o.i, CASE WHEN list_has_any(kept, coalesce(killers, [])) THEN kept ELSE list_append(kept, o.i) END
    FROM r{k} r JOIN o{k} o ON o.bin_file = r.bin_file AND o.i = r.i + 1 LEFT JOIN x{k} x ON x.bin_file = o.bin_file AND x.bi = o.i),
  k{k} AS (SELECT o.* EXCLUDE (i) FROM o{k} o JOIN (SELECT bin_file, unnest(arg_max(kept, i)) AS i FROM r{k} GROUP BY bin_file) USING (bin_file, i))"""

    return f"{one(1, 'cd', 'mc DESC', first)},\n  {one(2, 'k1', 'mc', second)}"


_STRINGS = f"""WITH RECURSIVE {_WITH[5:]}, cd AS (SELECT bin_file, pj, dyn, ver, matched_count AS mc, total_count AS tc FROM cand), it AS (SELECT DISTINCT bin_file, pj, dyn, ver, value FROM hit SEMI JOIN cand USING (bin_file, pj, dyn, ver)),
  {sql_greedy(True)}"""


def kept_strings(spark, d):
    index = staged(index_of(spark, d), "index")
    hits = staged(S.probe(index, B.binary_strings(spark, d)), "hits")
    found = staged(S.string_candidates(S.score_tables(hits), S.score_totals(index)), "candidates")
    return V.greedy_dedup(found, hits, "value", True)


@query("greedy_dedup_string", f"{_STRINGS} SELECT bin_file, pj, dyn, ver FROM k2")
def greedy_dedup_string(spark, d):
    return kept_strings(spark, d)


@query("string_verdict", f"{_STRINGS}, {_SQL_ALIAS} SELECT DISTINCT bin_file, {_FOLD} AS name FROM k2 s LEFT JOIN al o ON o.pj = s.pj AND o.dyn = s.dyn LEFT JOIN al g ON g.pj = s.pj AND g.dyn = '' WHERE coalesce(o.alias_pj, '') <> '' OR g.alias_pj IS NULL OR g.alias_pj <> ''")
def string_verdict(spark, d):
    return V.verdict(kept_strings(spark, d), alias_of(spark))


_ARRAYS = f"""WITH RECURSIVE {_INDEX}, {_BYTES}, {_SEARCH}, q AS (SELECT *, matched_count / total_count AS c, matched_len / total_len AS n, pj_score / total_pj_score AS s FROM (SELECT 'all' AS bin_file, pj, dyn, ver, sum(pj_score) AS pj_score, sum(matched_count) AS matched_count, sum(matched_len) AS matched_len
    FROM sc GROUP BY ALL) JOIN tot USING (pj, dyn, ver) WHERE total_pj_score <> 0),
  cd AS (SELECT bin_file, pj, dyn, ver, matched_count AS mc, total_count AS tc FROM q WHERE {_RULE}), it AS (SELECT DISTINCT 'all' AS bin_file, pj, dyn, ver, arr AS value FROM fh JOIN ix USING (arr)), {sql_greedy(False)}"""


@query("greedy_dedup_array", f"{_ARRAYS} SELECT bin_file, pj, dyn, ver FROM k2")
def greedy_dedup_array(spark, d):
    rows = orders_of(spark, d)
    index = staged(arrays_of(rows), "index")
    hits = staged(A.search_index(index, segments_of(rows)).withColumn("bin_file", F.lit("all")), "hits")
    found = staged(A.array_candidates(A.array_scores(hits, index), A.array_totals(index)), "candidates")
    items = hits.select("bin_file", "arr").distinct().join(index.select("arr", "pj", "dyn", "ver"), "arr").withColumn("item", F.concat_ws(",", F.col("arr").cast("array<string>")))
    return V.greedy_dedup(found, items, "item", False)


@query("merge_tables", f"""{_WITH}, p AS (SELECT bin_file, pj, dyn, ver, pj_score, value, CASE WHEN length(value) % 2 = 0 THEN 1 ELSE 2 END AS part FROM hit)
  SELECT bin_file, pj, dyn, ver, round(sum(pj_score), 6) AS pj_score, count(*) AS n, array_to_string(list_sort(list(part || ':' || length(value))), ' ') AS items FROM p GROUP BY ALL""")
def merge_tables(spark, d):
    hits = S.probe(index_of(spark, d), B.binary_strings(spark, d)).withColumn("size", F.length("value"))
    keys = ["bin_file", "pj", "dyn", "ver"]
    table = lambda k: hits.where(F.col("size") % 2 == k).groupBy(*keys).agg(F.sum("pj_score").alias("pj_score"), F.count("*").alias("n"), F.collect_list("size").alias("items"))
    out = V.merged_tables([table(0), table(1)], keys, ["pj_score", "n"], ["items"])
    return out.select(*keys, *_r("pj_score"), "n", F.array_join("items", " ").alias("items"))


@query("verdict_pivot", f"""WITH {B.SQL_SYMBOLS}, sh AS (SELECT lib, bin_file, count(*) AS score FROM (SELECT DISTINCT * FROM sexp) JOIN (SELECT DISTINCT * FROM bexp) USING (name) GROUP BY ALL), ns AS (SELECT lib, count(*) AS ns FROM sexp GROUP BY 1), nb AS (SELECT bin_file, count(*) AS nb FROM bexp GROUP BY 1),
  m AS (SELECT lib, bin_file, (ns > 5 AND score / ns >= 0.8) OR score > 20 OR (ns > 10 AND score / nb + score / ns >= 1.2) OR score / nb + score / ns >= 0.6 AS matched FROM sh JOIN ns USING (lib) JOIN nb USING (bin_file)),
  p AS (SELECT lib, string_agg(bin_file, ',' ORDER BY bin_file) AS bin_files FROM m WHERE matched GROUP BY lib), v AS (SELECT lib, bool_or(matched) AS reused FROM m GROUP BY lib)
  SELECT lib, 'export' AS feature, reused, bin_files FROM v LEFT JOIN p USING (lib)""")
def verdict_pivot(spark, d):
    """Exports under a looser rule, so that more than a few libraries match."""
    from ..operators.symbols import match_exports

    source, binary = B.source_symbols(spark, d), B.binary_symbols(spark, d)
    nb = binary.groupBy("bin_file").agg(F.count("*").alias("nb"))
    rows = match_exports(source, binary).join(nb, "bin_file")
    rows = rows.withColumn("matched", F.col("matched") | (F.col("score") / F.col("nb") + F.col("similarity") >= 0.6)).withColumns({"dyn": F.lit("all"), "feature": F.lit("export")})
    found = V.regrouped(rows).select("lib", F.array_join("bin_files", ",").alias("bin_files"))
    return V.reused(rows).join(found, "lib", "left").select("lib", F.lit("export").alias("feature"), "reused", "bin_files")
