"""Queries of sources, of the call over all families, and of stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import features as T
from . import bindings as B
from .match import match
from .registry import query
from .strings import _EXPORTS, SQL_PAIRWISE, _r
from .switches import _MATCHED, SQL_MATCHED, _full


@query("chosen_libraries", f"WITH {B.SQL_WORDS}, l AS (SELECT DISTINCT pj, ver FROM src) SELECT pj, min(ver) AS ver FROM l WHERE pj IN ('src1', 'src2', 'src19') GROUP BY pj")
def chosen_libraries(spark, d):
    libraries = B.source_strings(spark, d).select("pj", "ver").distinct()
    return T.chosen_libraries(libraries, ["src1", "src2", "src19"], True)


@query("analysed_projects", "SELECT p_brand AS pj, CAST(count(DISTINCT p_size) AS BIGINT) AS versions FROM part WHERE p_partkey % 3 = 1 GROUP BY 1")
def analysed_projects(spark, d):
    rows = B.table(spark, d, "part").select(F.col("p_brand").alias("pj"), F.col("p_size").alias("ver"), (F.col("p_partkey") % 3).cast("int").alias("analyse_status"))
    return T.analysed(rows).distinct().groupBy("pj").agg(F.count("*").alias("versions"))


@query("feature_load", """WITH dy AS (SELECT o_orderpriority AS lib, o_orderstatus AS dyn, o_orderkey AS id FROM orders), f AS (SELECT l_orderkey AS id, CAST(l_quantity AS BIGINT) AS v FROM lineitem)
  SELECT lib, dyn, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM dy JOIN f USING (id) GROUP BY ALL""")
def feature_load(spark, d):
    """Components' features by their source ids."""
    ids = B.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("lib"), F.col("o_orderstatus").alias("dyn")).agg(F.collect_list("o_orderkey").alias("src_source_ids"))
    features = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src_source_id"), F.col("l_quantity").cast("long").alias("v"))
    return T.features_of(ids, features).groupBy("lib", "dyn").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("literal_tokens", """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '"' || p_name || '"' WHEN 1 THEN 'L"' || p_name || '"' WHEN 2 THEN '""' ELSE p_name END AS s FROM part)
  SELECT p_partkey, CASE WHEN length(s) > 2 AND starts_with(s, '"') AND ends_with(s, '"') THEN substr(s, 2, length(s) - 2) END AS value FROM t""")
def literal_tokens(spark, d):
    token = F.expr("""CASE p_partkey % 4 WHEN 0 THEN concat('"', p_name, '"') WHEN 1 THEN concat('L"', p_name, '"') WHEN 2 THEN '""' ELSE p_name END""")
    return B.table(spark, d, "part").select("p_partkey", T.literal_text(token).alias("value"))


@query("match_all", f"""WITH {B.SQL_SYMBOLS}, {_EXPORTS} SELECT bin_file, lib AS library, 'all' AS dyn, 'export' AS feature, matched, round(similarity, 6) AS similarity, CAST(score AS DOUBLE) AS score FROM em""")
def match_all(spark, d):
    """The call over all families, with tables of one."""
    found = match({"export": B.source_symbols(spark, d).withColumn("dyn", F.lit("all"))}, {"export": B.binary_symbols(spark, d)})
    return found.select("bin_file", "library", "dyn", "feature", "matched", *_r("similarity"), "score")


@query("match_families", f"""WITH {B.SQL_WORDS}, {B.SQL_SYMBOLS}, {B.SQL_SWITCHES}, {_EXPORTS}, {SQL_PAIRWISE}, {SQL_MATCHED}
  SELECT bin_file, lib AS library, 'all' AS dyn, 'export' AS feature, matched, round(similarity, 6) AS similarity, CAST(score AS DOUBLE) AS score FROM em
  UNION ALL SELECT bin_file, pj, dyn, 'string', c / t.n > 0.5 OR (weights > 100 AND weights / w > 0.1), round(c / t.n, 6), round(weights, 6) FROM m JOIN t USING (pj, dyn)
  UNION ALL SELECT 'bin' || bin, 'lib' || lib, 'all', 'switch_case', {_MATCHED}, CAST(c AS DOUBLE), CAST(c AS DOUBLE) FROM c JOIN n USING (lib)""")
def match_families(spark, d):
    """The call over exports, strings and switches of the bound tables."""
    strings = B.source_strings(spark, d).withColumnRenamed("pj", "lib")
    switches = _full(B.source_switches(spark, d)).select(F.concat(F.lit("lib"), F.col("key") % 50).alias("lib"), F.lit("all").alias("dyn"), "case_value", "case_pool", "ncases", "targets")
    binary = _full(B.binary_switches(spark, d)).withColumn("bin_file", F.concat(F.lit("bin"), F.col("key") % 20))
    libraries = {"export": B.source_symbols(spark, d).withColumn("dyn", F.lit("all")), "string": strings.select("lib", "dyn", "value"), "switch": switches}
    found = match(libraries, {"export": B.binary_symbols(spark, d), "string": B.binary_strings(spark, d), "switch": binary})
    return found.select("bin_file", "library", "dyn", "feature", "matched", *_r("similarity", "score"))


@query("literal_array", """WITH t AS (SELECT p_partkey, p_size AS s FROM part) SELECT p_partkey, array_to_string(CASE p_partkey % 3 WHEN 0 THEN [s, s + 1, s * 16] WHEN 1 THEN [s] ELSE [255, s] END, ',') AS numbers FROM t""")
def literal_array(spark, d):
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('{', p_size, ', ', p_size + 1, 'u, 0x', hex(p_size * 16), 'L}') WHEN 1 THEN concat('{ name, ', p_size, ' }') ELSE concat('{0FFh,', p_size, ',}') END")
    return B.table(spark, d, "part").select("p_partkey", F.array_join(T.literal_array(text).cast("array<string>"), ",").alias("numbers"))


@query("first_items", f"WITH {B.SQL_SWITCHES} SELECT key, array_to_string([b[1] for b in case_value], ',') AS firsts FROM sw")
def first_items(spark, d):
    return B._switches(spark, d).select("key", F.array_join(T.first_items(F.col("case_value")).cast("array<string>"), ",").alias("firsts"))


@query("files_to_analyse", """WITH t AS (SELECT p_brand AS project, '/s/f' || p_partkey || CASE WHEN p_brand = 'Brand#3' OR p_size % 2 = 0 THEN '.h' ELSE '.c' END AS path FROM part), w AS (SELECT DISTINCT p_brand AS project, p_type AS dyn, '/s/f' || p_partkey || '.c' AS path FROM part WHERE p_brand IN ('Brand#1', 'Brand#2'))
  SELECT * FROM w UNION ALL SELECT project, 'fake_dynamic', path FROM t WHERE project NOT IN ('Brand#1', 'Brand#2') AND (ends_with(path, '.c') OR project NOT IN (SELECT project FROM t WHERE ends_with(path, '.c')))""")
def files_to_analyse(spark, d):
    part = B.table(spark, d, "part")
    tree = part.selectExpr("p_brand AS project", "concat('/s/f', p_partkey, CASE WHEN p_brand = 'Brand#3' OR p_size % 2 = 0 THEN '.h' ELSE '.c' END) AS path")
    wanted = part.where("p_brand IN ('Brand#1', 'Brand#2')").selectExpr("p_brand AS project", "p_type AS dyn", "concat('/s/f', p_partkey, '.c') AS path").distinct()
    return T.files_to_analyse(wanted, tree)
