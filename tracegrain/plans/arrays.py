"""Queries of the number-array families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoding as E
from ..operators import arrays as A
from ..staging import staged
from . import bindings as B
from .kernels import sql_continuous, sql_packed
from .registry import query
from .strings import _r

_NEEDLE = f"array_to_string([{sql_packed('x', 'w')} for x in arr], '')"


def orders_of(spark, d):
    return staged(B.order_arrays(spark, d), "orders")


def _sources(rows):
    """lib, arr, element_type, score, seq: arrays of all orders, half with a type"""
    kind = F.when(F.col("o_orderkey") % 2 == 0, F.lit("unsigned char"))
    return rows.select(F.concat_ws("-", "pj", "dyn").alias("lib"), "arr", kind.alias("element_type"), F.lit(1.0).alias("score"), F.col("o_orderkey").alias("seq"))


_SRC = f"""{B.SQL_ARRAYS}, sa AS (SELECT pj || '-' || dyn AS lib, arr, CASE WHEN o_orderkey % 2 = 0 THEN 'unsigned char' END AS element_type, o_orderkey AS seq FROM na),
  da AS (SELECT lib, arr, arg_min(coalesce(element_type, ''), seq) AS element_type, count(*) AS n FROM sa WHERE len(arr) >= 3 AND len([x for x in arr if x <> 0]) > 0 GROUP BY ALL),
  dw AS (SELECT lib, arr, n, unnest(CASE WHEN element_type <> '' THEN [2] ELSE [w for w in [2, 4, 8, 16] if w = 16 OR power(16, w) > list_max(arr)] END) AS w FROM da),
  nd AS (SELECT lib, arr, n, {_NEEDLE} AS needle FROM dw),
  nk AS (SELECT * FROM nd a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lib, needle FROM nd) b WHERE a.lib = b.lib AND length(b.needle) > length(a.needle) AND contains(b.needle, a.needle)))"""


def needles_of(rows):
    return A.needle_table(A.distinct_arrays(_sources(rows), "lib", "seq"), "lib")


@query("needle_build", f"WITH {_SRC} SELECT lib, array_to_string(arr, ',') AS arr, n AS count, needle FROM nd")
def needle_build(spark, d):
    return needles_of(B.order_arrays(spark, d)).select("lib", F.array_join(F.col("arr").cast("array<string>"), ",").alias("arr"), "count", "needle")


@query("needle_subsumption", f"WITH {_SRC} SELECT lib, array_to_string(arr, ',') AS arr, needle FROM nk")
def needle_subsumption(spark, d):
    return A.without_subsumed(staged(needles_of(B.order_arrays(spark, d)), "needles"), "lib").select("lib", F.array_join(F.col("arr").cast("array<string>"), ",").alias("arr"), "needle")


#: Binaries: the needles of a customer's own orders, one after the other; typed as bytes in one segment, wide in another.
_BYTES = f"""hx AS (SELECT o_custkey % 61 AS c, o_orderkey, arr, unnest([2, 8]) AS w FROM na WHERE o_orderkey % 3 <> 0), hn AS (SELECT c, o_orderkey, w, {_NEEDLE} AS h FROM hx),
  bb AS (SELECT 'bin' || c AS bin_file, CASE WHEN w = 2 THEN '.rdata' ELSE '.data' END AS seg, string_agg(h, '' ORDER BY o_orderkey) AS hex FROM hn GROUP BY ALL)"""


def segments_of(rows):
    mine = rows.where("o_orderkey % 3 <> 0").groupBy((F.col("o_custkey") % 61).alias("c")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "arr"))).alias("xs"))
    of = lambda w: F.array_join(F.transform("xs", lambda x: E.needle(x["arr"], F.lit(w))), "")
    segments = F.explode(F.array(F.struct(F.lit(".rdata").alias("seg"), of(2).alias("hex")), F.struct(F.lit(".data").alias("seg"), of(8).alias("hex"))))
    return mine.select(F.concat(F.lit("bin"), "c").alias("bin_file"), segments.alias("s")).select("bin_file", "s.seg", "s.hex")


_MATCH = """wb AS (SELECT bin_file, string_agg(hex, '' ORDER BY seg) AS hex FROM bb GROUP BY 1), ar AS (SELECT DISTINCT lib, arr, n * (log2(len(arr)) + 1) AS points FROM nk), tt AS (SELECT lib, sum(points) AS total FROM ar GROUP BY 1),
  hh AS (SELECT DISTINCT lib, arr, bin_file FROM nk JOIN wb ON contains(hex, needle)), ff AS (SELECT lib, bin_file, sum(points) AS success FROM hh JOIN ar USING (lib, arr) GROUP BY ALL)"""


def _matched(spark, d):
    rows = orders_of(spark, d)
    whole = segments_of(rows).groupBy("bin_file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "hex"))), lambda x: x["hex"]), "").alias("hex"))
    needles = staged(needles_of(rows), "needles")
    return A.match_arrays(staged(A.without_subsumed(needles, "lib"), "needles"), whole, "lib")


@query("num_match", f"""WITH {_SRC}, {_BYTES}, {_MATCH} SELECT lib, bin_file, round(success, 6) AS success, round(total, 6) AS total, round(success / total, 6) AS similarity,
  (total >= 50 AND success / total >= 0.5) OR (total > 5 AND total < 50 AND success / total >= 0.7) AS matched FROM ff JOIN tt USING (lib)""")
def num_match(spark, d):
    return _matched(spark, d).select("lib", "bin_file", *_r("success", "total", "similarity"), "matched")


@query("enum_match", f"""WITH {_SRC}, {_BYTES}, {_MATCH} SELECT lib, bin_file, success / total >= 0.5 AS match_field,
  (total >= 50 AND success / total >= 0.5) OR (total > 5 AND total < 50 AND success / total >= 0.7) AS matched FROM ff JOIN tt USING (lib)""")
def enum_match(spark, d):
    """Enums match like numbers, but what is reported as a match is half of the total alone."""
    return _matched(spark, d).select("lib", "bin_file", F.col("matched_simple").alias("match_field"), "matched")


#: The index by SQL. Entropy is given: twelve for all arrays but those of a customer in five.
_INDEX = f"""{B.SQL_ARRAYS}, en AS (SELECT pj, dyn, ver, CASE WHEN o_custkey % 5 = 0 THEN 5 ELSE 12 END AS entropy, [i for i in range(1, len(arr) + 1) if arr[i] <> 0] AS nz, arr FROM na),
  tr AS (SELECT pj, dyn, ver, entropy, arr[nz[1]:nz[-1]] AS arr FROM en), fw AS (SELECT arr, count(DISTINCT pj) AS projects, max(entropy) AS entropy FROM tr GROUP BY arr),
  tk AS (SELECT arr FROM fw WHERE len(arr) >= 4 AND entropy >= 10 AND projects < 10 AND NOT {sql_continuous('arr')}), post AS (SELECT DISTINCT arr, pj, dyn, ver FROM tr SEMI JOIN tk USING (arr)),
  pv AS (SELECT pj, count(DISTINCT ver) AS ver_cnt FROM na GROUP BY pj), rp AS (SELECT arr, count(DISTINCT pj) AS rel FROM post GROUP BY arr), rv AS (SELECT arr, pj, dyn, count(*) AS rel_ver FROM post GROUP BY ALL),
  ix AS (SELECT post.*, ln(len(arr)) * log10((SELECT count(*) FROM pv) / rel) AS pj_score, ln(len(arr)) * log10(ver_cnt / rel_ver) AS ver_score FROM post JOIN rp USING (arr) JOIN rv USING (arr, pj, dyn) JOIN pv USING (pj)),
  tot AS (SELECT pj, dyn, ver, sum(pj_score) AS total_pj_score, sum(ver_score) AS total_ver_score, count(*) AS total_count, sum(len(arr)) AS total_len FROM ix GROUP BY ALL)"""


def index_of(rows):
    some = rows.select("pj", "dyn", "ver", "arr", F.when(F.col("o_custkey") % 5 == 0, 5).otherwise(12).alias("entropy"))
    return A.array_index(some, rows.select("pj", "ver"))


@query("admission", f"WITH {_INDEX} SELECT array_to_string(arr, ',') AS arr FROM tk")
def admission(spark, d):
    return index_of(B.order_arrays(spark, d)).select(F.array_join(F.col("arr").cast("array<string>"), ",").alias("arr")).distinct()


@query("array_totals", f"WITH {_INDEX} SELECT pj, dyn, ver, round(total_pj_score, 6) AS total_pj_score, round(total_ver_score, 6) AS total_ver_score, total_count, CAST(total_len AS BIGINT) AS total_len FROM tot")
def array_totals(spark, d):
    return A.array_totals(index_of(B.order_arrays(spark, d))).select("pj", "dyn", "ver", *_r("total_pj_score", "total_ver_score"), "total_count", "total_len")


_SEARCH = f"""sn AS (SELECT arr, unnest([w for w in [2, 4, 8, 16] if w = 16 OR power(16, w) > list_max(arr)]) AS w FROM (SELECT DISTINCT arr FROM ix)), sx AS (SELECT arr, {_NEEDLE} AS needle FROM sn),
  fh AS (SELECT DISTINCT bin_file, seg, arr FROM (SELECT bin_file, seg, regexp_replace(hex, '(..)', '\\1 ', 'g') AS bytes FROM bb) JOIN (SELECT arr, regexp_replace(needle, '(..)', '\\1 ', 'g') AS part FROM sx) ON contains(bytes, part)),
  sc AS (SELECT bin_file, pj, dyn, ver, sum(pj_score) AS pj_score, sum(ver_score) AS ver_score, count(*) AS matched_count, sum(len(arr)) AS matched_len FROM fh JOIN ix USING (arr) GROUP BY ALL)"""


@query("array_match_index", f"""WITH {_INDEX}, {_BYTES}, {_SEARCH} SELECT bin_file, pj, dyn, ver, round(pj_score, 6) AS pj_score, round(ver_score, 6) AS ver_score, matched_count, CAST(matched_len AS BIGINT) AS matched_len FROM sc""")
def array_match_index(spark, d):
    rows = orders_of(spark, d)
    index = staged(index_of(rows), "index")
    scores = A.array_scores(A.search_index(index, segments_of(rows)), index)
    return scores.select("bin_file", "pj", "dyn", "ver", *_r("pj_score", "ver_score"), "matched_count", "matched_len")


_RULE = """(total_count > 5 OR total_len > 50 OR total_pj_score > 50) AND pj_score > 15 AND (c >= 0.7 OR (c >= 0.5 AND n > 0.7) OR (c >= 0.5 AND s >= 0.7) OR (c >= 0.5 AND n > 0.5 AND s >= 0.5) OR n + s >= 1.5 OR (pj_score > 50 AND c >= 0.5))"""


@query("array_candidates", f"""WITH {_INDEX}, {_BYTES}, {_SEARCH}, q AS (SELECT *, matched_count / total_count AS c, matched_len / total_len AS n, pj_score / total_pj_score AS s FROM (SELECT 'all' AS bin_file, pj, dyn, ver, sum(pj_score) AS pj_score, sum(matched_count) AS matched_count, sum(matched_len) AS matched_len FROM sc GROUP BY ALL) JOIN tot USING (pj, dyn, ver) WHERE total_pj_score <> 0)
  SELECT pj, dyn, ver, round(c, 6) AS count_sim, round(n, 6) AS len_sim, round(s, 6) AS score_sim FROM q WHERE {_RULE}""")
def array_candidates(spark, d):
    """The rule on all binaries of one product together."""
    rows = orders_of(spark, d)
    index = staged(index_of(rows), "index")
    scores = A.array_scores(A.search_index(index, segments_of(rows)), index)
    product = scores.groupBy(F.lit("all").alias("bin_file"), "pj", "dyn", "ver").agg(*(F.sum(c).alias(c) for c in ("pj_score", "matched_count", "matched_len")))
    return A.array_candidates(product, A.array_totals(index)).select("pj", "dyn", "ver", *_r("count_sim", "len_sim", "score_sim"))


@query("passby", f"""WITH {B.SQL_ARRAYS}, q AS (SELECT DISTINCT [x // 10 for x in arr] AS arr, pj, dyn, ver FROM na WHERE len(arr) >= 4), st AS (SELECT DISTINCT arr FROM q),
  sl AS (SELECT DISTINCT unnest(flatten([[arr[i:k] for k in range(i + 3, len(arr) + 1)] for i in range(1, len(arr) - 2)])) AS arr FROM st) SELECT array_to_string(arr, ',') AS arr, pj, dyn, ver FROM q SEMI JOIN sl USING (arr)""")
def passby(spark, d):
    rows = B.order_arrays(spark, d).where(F.size("arr") >= 4).select(F.transform("arr", lambda x: F.floor(x / 10)).alias("arr"), "pj", "dyn", "ver").distinct()
    return A.passed_by(rows).select(F.array_join(F.col("arr").cast("array<string>"), ",").alias("arr"), "pj", "dyn", "ver")


@query("passby_counts", f"""WITH {B.SQL_ARRAYS}, st AS (SELECT DISTINCT [x // 10 for x in arr] AS arr FROM na WHERE len(arr) >= 4), sl AS (SELECT arr AS outer_, unnest(list_distinct(flatten([[arr[i:k] for k in range(i + 3, len(arr) + 1)] for i in range(1, len(arr) - 2)]))) AS arr FROM st)
  SELECT array_to_string(arr, ',') AS arr, count(*) AS inside FROM sl SEMI JOIN st USING (arr) GROUP BY arr""")
def passby_counts(spark, d):
    """In how many stored arrays each stored array stands."""
    stored = B.order_arrays(spark, d).where(F.size("arr") >= 4).select(F.transform("arr", lambda x: F.floor(x / 10)).alias("arr")).distinct()
    n = F.size("arr")
    starts = F.sequence(F.lit(1), n - 3)
    slices = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(4), n - i + 1), lambda k: F.slice(F.col("arr"), i, k))))
    inner = stored.select(F.explode(F.array_distinct(slices)).alias("arr"))
    return inner.join(stored, "arr", "left_semi").groupBy("arr").agg(F.count("*").alias("inside")).select(F.array_join(F.col("arr").cast("array<string>"), ",").alias("arr"), "inside")


@query("array_lookup", f"WITH {_INDEX} SELECT o_orderkey, ix.pj, ix.dyn, ix.ver, round(pj_score, 6) AS pj_score FROM na JOIN ix USING (arr)")
def array_lookup(spark, d):
    rows = B.order_arrays(spark, d)
    return rows.select("o_orderkey", "arr").join(index_of(rows), "arr").select("o_orderkey", "pj", "dyn", "ver", *_r("pj_score"))
