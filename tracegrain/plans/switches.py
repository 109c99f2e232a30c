"""Queries of switches, condition chains and text reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import switches as S
from . import bindings as B
from .registry import query
from .strings import _r


def _text(c):
    return F.array_join(F.transform(c, lambda b: F.array_join(b.cast("array<string>"), ",")), "|")


_TEXT = "array_to_string([array_to_string(b, ',') for b in {0}], '|')"
_POOL = "[len(b) for b in {0}]"


def _full(rows):
    return rows.select("key", "case_value", S.case_pool(F.col("case_value")).alias("case_pool"), F.size(F.flatten("case_value")).alias("ncases"), F.size("case_value").alias("targets"))


@query("switch_normalize", f"WITH {B.SQL_SWITCHES} SELECT key, {_TEXT.format('case_value')} AS case_value, array_to_string({_POOL.format('case_value')}, ',') AS case_pool FROM bsw")
def switch_normalize(spark, d):
    rows = B.binary_switches(spark, d).withColumn("case_value", S.normalized_cases(F.col("case_value")))
    return rows.select("key", _text("case_value").alias("case_value"), F.array_join(S.case_pool(F.col("case_value")).cast("array<string>"), ",").alias("case_pool"))


@query("switch_merge", f"""WITH {B.SQL_SWITCHES}, q AS (SELECT key, [[v // 25 for v in b] for b in case_value] AS case_value FROM sw)
  SELECT {_TEXT.format('case_value')} AS case_value, arg_min(key % 100, key) AS ncases, string_agg('f' || key, ',' ORDER BY key) AS functions FROM q GROUP BY case_value""")
def switch_merge(spark, d):
    rows = B.source_switches(spark, d).select("key", F.when(F.col("key") % 3 == 0, F.transform("case_value", lambda b: F.transform(b, lambda v: v - 1))).otherwise(F.col("case_value")).alias("case_value"))
    rows = rows.select(F.lit("all").alias("lib"), "key", F.concat(F.lit("f"), "key").alias("function"), (F.col("key") % 100).alias("ncases"), F.lit(2).alias("targets"), F.transform("case_value", lambda b: F.transform(b, lambda v: F.floor(v / 25))).alias("case_value"))
    return S.merged_switches(rows, ["lib"], "key").select(_text("case_value").alias("case_value"), "ncases", F.array_join("functions", ",").alias("functions"))


@query("switch_special", f"""WITH {B.SQL_SWITCHES}, q AS (SELECT key, case_value AS cv FROM ssw) SELECT key, len(cv) >= 4 AND (len(flatten(cv)) - len(cv) > 1 OR cv[-1][1] - cv[1][1] > len(cv) + 3) AS special_source,
  len(cv) >= 3 AND (len(flatten(cv)) - len(cv) > 1 OR cv[-1][1] - cv[1][1] > len(cv) + 3) AS special_binary FROM q""")
def switch_special(spark, d):
    rows = _full(B.source_switches(spark, d))
    test = lambda s: S.is_special(F.col("targets"), F.col("ncases"), F.col("case_value"), s)
    return rows.select("key", test(True).alias("special_source"), test(False).alias("special_binary"))


#: DuckDB has the pairs by trying each removal; Spark joins on the removals.
_PAIRS = "bv AS (SELECT key AS b_key, case_value AS b_case_value, unnest(list_distinct([case_value[1:i - 1] || case_value[i + 1:] for i in range(1, len(case_value) + 1)])) AS k FROM bsw)"


@query("delete_one", f"WITH {B.SQL_SWITCHES}, {_PAIRS} SELECT key, b_key FROM ssw JOIN bv ON case_value = k")
def delete_one(spark, d):
    return S.delete_one_pairs(B.source_switches(spark, d), B.binary_switches(spark, d), False).select("key", "b_key")


_MOVED = "[[v - list_min(flatten(case_value)) for v in b] for b in case_value]"


@query("rebase_match", f"""WITH {B.SQL_SWITCHES}, {_PAIRS}, s AS (SELECT key, [[v + 3 for v in b] for b in case_value] AS case_value FROM sw), b0 AS (SELECT key AS b_key, [[v - list_min(flatten(case_value)) for v in b] for b in case_value] AS c FROM sw),
  b1 AS (SELECT b_key, list_sort(list_append(c, [CAST(99 AS BIGINT)])) AS c FROM b0), bz AS (SELECT b_key, unnest(list_distinct([c[1:i - 1] || c[i + 1:] for i in range(1, len(c) + 1)])) AS k FROM b1)
  SELECT key, b_key FROM (SELECT key, {_MOVED} AS k FROM s) JOIN bz USING (k)""")
def rebase_match(spark, d):
    plain = B.binary_switches(spark, d).where("key % 2 = 1").unionByName(B.binary_switches(spark, d).where("key % 2 = 0").select("key", F.filter("case_value", lambda b: b != F.array(F.lit(0).cast("long"))).alias("case_value")))
    source = plain.select("key", F.transform("case_value", lambda b: F.transform(b, lambda v: v + 3)).alias("case_value"))
    binary = plain.select("key", F.array_sort(F.concat(S.rebased(F.col("case_value")), F.array(F.array(F.lit(99).cast("long"))))).alias("case_value"))
    return S.delete_one_pairs(source, binary).where("rebased").select("key", "b_key")


#: Switches: c (lib, bin, c) with n (lib, special).
SQL_MATCHED = f"""{_PAIRS}, sp AS (SELECT key % 50 AS lib, case_value FROM ssw WHERE len(case_value) >= 4 AND (len(flatten(case_value)) - len(case_value) > 1 OR case_value[-1][1] - case_value[1][1] > len(case_value) + 3)),
  n AS (SELECT lib, count(*) AS special FROM sp GROUP BY 1), z AS (SELECT * FROM bv WHERE len([b for b in b_case_value if list_contains(b, 0)]) > 0),
  h AS (SELECT lib, case_value, b_key FROM sp JOIN bv ON case_value = k UNION SELECT lib, case_value, b_key FROM (SELECT lib, case_value, {_MOVED} AS k FROM sp WHERE len([b for b in case_value if list_contains(b, 0)]) = 0) JOIN z USING (k)),
  c AS (SELECT lib, b_key % 20 AS bin, count(DISTINCT case_value) AS c FROM h GROUP BY ALL)"""
_MATCHED = "special >= 5 AND ((c > 2 AND c / special * 100 >= 50) OR (c > 5 AND c / special * 100 >= 20))"


@query("switch_match", f"""WITH {B.SQL_SWITCHES}, {SQL_MATCHED} SELECT 'lib' || lib AS lib, 'bin' || bin AS bin_file, special, c AS count, {_MATCHED} AS matched FROM c JOIN n USING (lib)""")
def switch_match(spark, d):
    source = _full(B.source_switches(spark, d)).withColumn("lib", F.concat(F.lit("lib"), F.col("key") % 50))
    binary = _full(B.binary_switches(spark, d)).withColumn("bin_file", F.concat(F.lit("bin"), F.col("key") % 20))
    return S.match_switches(source, binary)


@query("nested_if_parse", f"""WITH {B.SQL_CHAINS}, p AS (SELECT user_id, [[split_part(x, ':', 1), split_part(x, ':', 2)] for x in chain] AS c FROM ch WHERE len(chain) >= 3)
  SELECT DISTINCT user_id, array_to_string([CAST(x[1] AS BIGINT) * 2 || '/' || length(x[2]) for x in c], ' ') AS chain FROM p""")
def nested_if_parse(spark, d):
    """Chains as `num, mark` texts, parsed, of three steps at least, once each."""
    texts = F.transform("chain", lambda x: F.concat_ws(", ", (F.split_part(x, F.lit(":"), F.lit(1)).cast("long") * 2).cast("string"), F.length(F.split_part(x, F.lit(":"), F.lit(2))).cast("string")))
    rows = S.long_chains(B.chains(spark, d)).select("user_id", S.parsed_chain(texts).alias("c"))
    return rows.select("user_id", F.array_join(F.transform("c", lambda s: F.concat_ws("/", s["num"].cast("string"), s["mark"].cast("string"))), " ").alias("chain")).distinct()


def _sides(spark, d):
    """Sources are even users, binaries odd ones, of chains of three steps at least."""
    rows = S.long_chains(B.chains(spark, d)).withColumn("id", F.concat_ws("@", "user_id", "day"))
    return rows.where("user_id % 2 = 0"), rows.where("user_id % 2 = 1")


@query("nested_if_overlap", f"""WITH {B.SQL_CHAINS}, l AS (SELECT user_id, user_id || '@' || day AS id, len(chain) AS n, unnest(list_distinct(chain)) AS step FROM ch WHERE len(chain) >= 3), j AS (SELECT s.id AS s_id, b.id AS b_id, s.n AS sn, b.n AS bn, count(*) AS overlap
  FROM l s JOIN l b USING (step) WHERE s.user_id % 2 = 0 AND b.user_id % 2 = 1 GROUP BY ALL) SELECT s_id, b_id, overlap, round(overlap / greatest(sn, bn) * 100, 6) AS percent FROM j WHERE overlap / greatest(sn, bn) * 100 > 40 AND overlap >= 3""")
def nested_if_overlap(spark, d):
    return S.chain_overlaps(*_sides(spark, d), over=40, digits=6)


#: Sources in order, each with the binary chains that it would take, best first; what a pair has used up goes with the recursion.
_GREEDY = """l AS (SELECT * FROM ch WHERE len(chain) >= 3),
  s AS (SELECT 'lib' || (user_id % 40) AS lib, row_number() OVER (PARTITION BY user_id % 40 ORDER BY day, user_id) AS i, chain FROM l WHERE user_id % 2 = 0),
  b AS (SELECT 'bin' || (user_id % 41) AS bin_file, row_number() OVER (PARTITION BY user_id % 41 ORDER BY day, user_id) AS j, chain FROM l WHERE user_id % 2 = 1),
  ss AS (SELECT lib, i, unnest(list_distinct(chain)) AS step FROM s), bs AS (SELECT bin_file, j, unnest(list_distinct(chain)) AS step FROM b),
  ov AS (SELECT lib, i, bin_file, j, count(*) AS n FROM ss JOIN bs USING (step) GROUP BY ALL), ns AS (SELECT lib, count(*) AS n FROM s GROUP BY lib HAVING count(*) >= 3),
  cd AS (SELECT lib, i, bin_file, j, s.chain = b.chain AS same, n FROM ov JOIN s USING (lib, i) JOIN b USING (bin_file, j) WHERE s.chain = b.chain OR (n >= 3 AND n / greatest(len(s.chain), len(b.chain)) * 100 > 40)),
  cl AS (SELECT lib, bin_file, i, list({'other': NOT same, 'less': CASE WHEN same THEN 0 ELSE -n END, 'j': j} ORDER BY NOT same, CASE WHEN same THEN 0 ELSE -n END, j) AS x FROM cd GROUP BY ALL),
  g(lib, bin_file, i, used, taken, whole) AS (SELECT DISTINCT lib, bin_file, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ov SEMI JOIN ns USING (lib)
    UNION ALL SELECT lib, bin_file, i, CASE WHEN y IS NULL THEN used ELSE list_append(used, y.j) END, taken + CASE WHEN y IS NULL THEN 0 ELSE 1 END, whole + CASE WHEN y IS NOT NULL AND NOT y.other THEN 1 ELSE 0 END
    FROM (SELECT g.lib, g.bin_file, g.i + 1 AS i, used, taken, whole, list_filter(cl.x, lambda z: NOT list_contains(used, z.j))[1] AS y FROM g JOIN ns ON g.lib = ns.lib AND g.i < ns.n LEFT JOIN cl ON cl.lib = g.lib AND cl.bin_file = g.bin_file AND cl.i = g.i + 1))"""


@query("nested_if_match", f"""WITH RECURSIVE {B.SQL_CHAINS}, {_GREEDY} SELECT lib, bin_file, taken AS count, whole AS "full", round(taken / n * 100, 6) AS similarity, taken > 5 AND taken / n * 100 > 75 AS matched FROM g JOIN ns USING (lib) WHERE i = n""")
def nested_if_match(spark, d):
    source, binary = _sides(spark, d)
    source = source.select(F.concat(F.lit("lib"), F.col("user_id") % 40).alias("lib"), F.struct("day", "user_id").alias("seq"), "chain")
    binary = binary.select(F.concat(F.lit("bin"), F.col("user_id") % 41).alias("bin_file"), F.struct("day", "user_id").alias("seq"), "chain")
    return S.match_chains(source, binary).select("lib", "bin_file", "count", "full", *_r("similarity"), "matched")


_REPORT = """ln AS (SELECT p_brand AS file, p_partkey * 10 + k AS line_no, CASE k WHEN 0 THEN 'Function: f' || p_partkey WHEN 1 THEN 'ncases: ' || (p_size + 1) WHEN 2 THEN 'Cur_Case: ' || (p_size % 9) || ' ' || (p_size % 4) || ' Target: bb1'
  WHEN 3 THEN 'Cur_Case: default Target: bb2' WHEN 4 THEN 'Cur_Case: ' || p_size || ' Target: bb3' ELSE 'noise' END AS line FROM part, unnest(range(0, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 6 END)) u(k))"""


def _report(spark, d):
    rows = B.table(spark, d, "part").withColumn("k", F.explode(F.expr("sequence(0, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 5 END)")))
    line = F.expr("""CASE k WHEN 0 THEN concat('Function: f', p_partkey) WHEN 1 THEN concat('ncases: ', p_size + 1) WHEN 2 THEN concat('Cur_Case: ', p_size % 9, ' ', p_size % 4, ' Target: bb1')
      WHEN 3 THEN 'Cur_Case: default Target: bb2' WHEN 4 THEN concat('Cur_Case: ', p_size, ' Target: bb3') ELSE 'noise' END""")
    return rows.select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 10 + F.col("k")).alias("line_no"), line.alias("line"))


@query("switch_report_parse", """SELECT p_brand AS file, 'f' || p_partkey AS function_name, p_size + 1 AS targets, CAST(CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS ncases,
  array_to_string([array_to_string(b, ',') for b in list_sort(CASE WHEN p_partkey % 3 = 0 THEN [list_sort([p_size % 9, p_size % 4])] ELSE [list_sort([p_size % 9, p_size % 4]), [p_size]] END)], '|') AS case_value FROM part""")
def switch_report_parse(spark, d):
    return S.switch_report(_report(spark, d)).select("file", "function_name", "targets", "ncases", _text("case_value").alias("case_value"))


_CMP = """ln AS (SELECT 'r' || (user_id % 50) AS file, user_id, ts, event_id, CAST(floor(value) AS BIGINT) % 5 AS num, length(event_type) % 3 AS mark FROM events)"""


@query("if_report_parse", f"""WITH {_CMP}, s AS (SELECT file, user_id, num || ', ' || mark AS step, min((ts, event_id)) AS t0 FROM ln WHERE NOT (num = 0 AND mark = 0) GROUP BY ALL)
  SELECT file, 'u' || user_id AS function_name, string_agg(step, ' ' ORDER BY t0) AS chain FROM s GROUP BY file, user_id HAVING count(*) > 2""")
def if_report_parse(spark, d):
    return S.condition_report(_condition_lines(spark, d)).select("file", "function_name", F.array_join("chain", " ").alias("chain"))


def _condition_lines(spark, d):
    events = B.table(spark, d, "events").select(F.concat(F.lit("r"), F.col("user_id") % 50).alias("file"), "user_id", "ts", "event_id", F.concat_ws(", ", (F.floor("value").cast("long") % 5).cast("string"), (F.length("event_type") % 3).cast("string")).alias("step"))
    head = events.select("file", "user_id").distinct().select("file", F.struct("user_id", F.lit(0).alias("k"), F.lit(None).cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("event_id")).alias("line_no"), F.concat(F.lit("Function: u"), "user_id").alias("line"))
    body = events.select("file", F.struct("user_id", F.lit(1).alias("k"), "ts", "event_id").alias("line_no"), F.concat(F.lit("CMP_INFOS: "), "step").alias("line"))
    return head.unionByName(body)


@query("if_report_mirrored", f"""WITH {_CMP}, s AS (SELECT file, user_id, num || ', ' || mark AS step, min((ts, event_id)) AS t0 FROM ln WHERE NOT (num = 0 AND mark = 0) GROUP BY ALL),
  c AS (SELECT file, user_id, string_agg(step, ' ' ORDER BY t0) AS chain, count(*) AS n FROM s GROUP BY file, user_id), u AS (SELECT file, user_id, lead('u' || user_id) OVER (PARTITION BY file ORDER BY user_id) AS function_name FROM (SELECT DISTINCT file, user_id FROM ln))
  SELECT file, function_name, chain FROM c JOIN u USING (file, user_id) WHERE n > 2 AND function_name IS NOT NULL""")
def if_report_mirrored(spark, d):
    return S.condition_report(_condition_lines(spark, d), mirror=True).select("file", "function_name", F.array_join("chain", " ").alias("chain"))


@query("compare_instruction", """WITH i AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'cmp     eax, ' || p_size WHEN 1 THEN 'cmp     [ebp+var_4], ' || to_hex(p_size) || 'h' WHEN 2 THEN 'cmp ecx, edx' WHEN 3 THEN 'cmp al, AH' WHEN 4 THEN 'mov eax, 5' ELSE 'cmp     ebx, 0FF' || to_hex(p_size) || 'h' END AS s,
  CASE p_size % 4 WHEN 0 THEN 'jle' WHEN 1 THEN 'jnb' WHEN 2 THEN 'jz' ELSE 'jmp' END AS j FROM part)
  SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN CAST(substr(s, 14) AS BIGINT) WHEN 1 THEN CAST('0x' || replace(substr(s, 22), 'h', '') AS BIGINT) WHEN 3 THEN 10 WHEN 5 THEN CAST('0x' || replace(substr(s, 14), 'h', '') AS BIGINT) END AS BIGINT) AS num,
    CASE j WHEN 'jle' THEN 2 WHEN 'jnb' THEN 1 WHEN 'jz' THEN 0 END AS mark FROM i""")
def compare_instruction(spark, d):
    text = F.expr("""CASE p_partkey % 6 WHEN 0 THEN concat('cmp     eax, ', p_size) WHEN 1 THEN concat('cmp     [ebp+var_4], ', hex(p_size), 'h') WHEN 2 THEN 'cmp ecx, edx' WHEN 3 THEN 'cmp al, AH' WHEN 4 THEN 'mov eax, 5' ELSE concat('cmp     ebx, 0FF', hex(p_size), 'h') END""")
    jump = F.expr("CASE p_size % 4 WHEN 0 THEN 'jle' WHEN 1 THEN 'jnb' WHEN 2 THEN 'jz' ELSE 'jmp' END")
    return B.table(spark, d, "part").select("p_partkey", S.compare_operand(text).alias("num"), S.jump_class(jump).alias("mark"))


#: All paths, from blocks without a predecessor to blocks without a successor; of each function the maximal sets of conditions.
_PATHS = """bl AS (SELECT l_orderkey AS f, CAST(l_linenumber AS BIGINT) AS b, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL),
  cn AS (SELECT f, b, CASE WHEN q % 7 = 0 AND q % 3 = 0 THEN [] ELSE [{'n': q % 7, 'm': q % 3}] END AS own FROM bl), ed AS (SELECT f, b, b + unnest([1, 2]) AS s FROM bl),
  nx AS (SELECT DISTINCT f, s FROM ed), st AS (SELECT * FROM cn ANTI JOIN nx ON nx.f = cn.f AND nx.s = cn.b),
  wk(f, b, c) AS (SELECT f, b, own FROM st UNION SELECT ed.f, ed.s, wk.c || coalesce(cn.own, []) FROM wk JOIN ed USING (f, b) LEFT JOIN cn ON cn.f = ed.f AND cn.b = ed.s),
  ch AS (SELECT DISTINCT f, c, list_sort(list_distinct(c)) AS e FROM wk ANTI JOIN cn ON cn.f = wk.f AND cn.b = wk.b),
  fs AS (SELECT f, e, arg_min(c, {'less': -len(c), 'c': c}) AS c FROM ch GROUP BY f, e),
  mx AS (SELECT * FROM fs x WHERE NOT EXISTS (SELECT 1 FROM fs y WHERE x.f = y.f AND len(y.e) > len(x.e) AND list_has_all(y.e, x.e)))"""


@query("cfg_chains", f"""WITH RECURSIVE {_PATHS} SELECT f AS function, array_to_string([x.n || ', ' || x.m for x in c], '; ') AS chain FROM mx WHERE len(c) > 2""")
def cfg_chains(spark, d):
    """Each order's lines are a function's blocks, in a row with a jump over every other."""
    lines = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("function"), F.col("l_linenumber").cast("long").alias("block"), F.col("l_quantity").cast("long").alias("num")).groupBy("function", "block").agg(F.max("num").alias("num"))
    step = F.explode(F.array(F.lit(1), F.lit(2)))
    edges = lines.withColumn("step", step).select("function", "block", (F.col("block") + F.col("step")).alias("succ"), (F.col("num") % 7).alias("num"), F.pmod("num", F.lit(3)).cast("int").alias("mark"))
    return S.function_chains(edges).select("function", F.array_join("chain", "; ").alias("chain"))
