"""The tables of a matching job, bound to the tables at hand by shape: words as strings, orders as number arrays,
parts as symbols and switches, events as condition chains. Each has its SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One fold of five is binaries, the rest is libraries; versions are cut across both.
_FOLD, _VERSION = "(doc_id div 20) % 5", "(doc_id div 20) % 3"

SQL_WORDS = """
w AS (SELECT doc_id, source, lang, (doc_id // 20) % 3 AS ver, (doc_id // 20) % 5 AS fold, unnest(string_split(text, ' ')) AS value FROM documents),
src AS (SELECT source AS pj, lang AS dyn, CAST(ver AS VARCHAR) AS ver, value FROM w WHERE fold <> 0 AND value <> ''),
bin AS (SELECT source AS bin_file, value FROM w WHERE fold = 0 AND value <> '')
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "lang", f"{_VERSION} AS ver", f"{_FOLD} AS fold", "explode(split(text, ' ', -1)) AS value")
    return docs.where("value <> ''")


def source_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pj, dyn, ver, value"""
    return words(spark, sf_dir).where("fold <> 0").selectExpr("source AS pj", "lang AS dyn", "CAST(ver AS STRING) AS ver", "value")


def binary_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin_file, value; as often as it occurs"""
    return words(spark, sf_dir).where("fold = 0").selectExpr("source AS bin_file", "value")


SQL_ARRAYS = """
oa AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS arr FROM lineitem GROUP BY l_orderkey),
na AS (SELECT o_orderkey, o_custkey, o_orderpriority AS pj, o_orderstatus AS dyn, CAST(year(o_orderdate) AS VARCHAR) AS ver, arr FROM oa JOIN orders ON l_orderkey = o_orderkey)
"""


def order_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey, pj, dyn, ver, arr: the quantities of each order in a total order of its lines; lines that are equal
    up to the quantity give the same array in any order"""
    lines = table(spark, sf_dir, "lineitem")
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    arrays = lines.groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["l_quantity"].cast("long")).alias("arr"))
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderpriority AS pj", "o_orderstatus AS dyn", "CAST(year(o_orderdate) AS STRING) AS ver")
    return arrays.join(orders, arrays.l_orderkey == orders.o_orderkey).select("o_orderkey", "o_custkey", "pj", "dyn", "ver", "arr")


SQL_SYMBOLS = """
bexp AS (SELECT p_brand || '-' || (p_size % 10) AS bin_file, p_name AS name FROM part),
sexp AS (SELECT p_type || '-' || p_size AS lib, p_name AS name FROM part)
"""


def binary_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("concat(p_brand, '-', p_size % 10) AS bin_file", "p_name AS name")


def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("concat(p_type, '-', p_size) AS lib", "p_name AS name")


SQL_SWITCHES = """
br AS (SELECT l_partkey, l_linenumber, list_sort(list(DISTINCT CAST(l_quantity AS BIGINT))) AS branch FROM lineitem GROUP BY l_partkey, l_linenumber),
sw AS (SELECT l_partkey AS key, list_sort(list(branch)) AS case_value FROM br GROUP BY l_partkey),
ssw AS (SELECT key, CASE WHEN key % 3 = 0 THEN [[v + 1 for v in b] for b in case_value] ELSE case_value END AS case_value FROM sw),
bsw AS (SELECT key, CASE WHEN key % 2 = 0 THEN list_sort(list_append(case_value, [CAST(0 AS BIGINT)])) ELSE case_value END AS case_value FROM sw)
"""


def _switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.array_sort(F.collect_set(F.col("l_quantity").cast("long"))).alias("branch"))
    return branch.groupBy(F.col("l_partkey").alias("key")).agg(F.array_sort(F.collect_list("branch")).alias("case_value"))


def source_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, case_value: a third has labels one higher"""
    moved = F.transform("case_value", lambda b: F.transform(b, lambda v: v + 1))
    return _switches(spark, sf_dir).select("key", F.when(F.col("key") % 3 == 0, moved).otherwise(F.col("case_value")).alias("case_value"))


def binary_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, case_value: half have a branch more, as binaries do"""
    zero = F.array(F.array(F.lit(0).cast("long")))
    return _switches(spark, sf_dir).select("key", F.when(F.col("key") % 2 == 0, F.array_sort(F.concat("case_value", zero))).otherwise(F.col("case_value")).alias("case_value"))


SQL_CHAINS = """
ch AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, list(CAST(floor(value) AS BIGINT) % 6 || ':' || event_type ORDER BY ts, event_id) AS chain FROM events GROUP BY 1, 2)
"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, chain of `number:mark`; even users are sources, odd ones binaries"""
    step = F.concat_ws(":", (F.floor("value").cast("long") % 6).cast("string"), "event_type")
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", step.alias("step")).alias("x"))
    return events.groupBy("user_id", "day").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["step"]).alias("chain"))
