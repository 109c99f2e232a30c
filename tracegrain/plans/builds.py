"""Queries of build logs and dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import verdicts as V
from ..sources import buildlog as L
from . import bindings as B
from .registry import query

_LINE = """CASE p_partkey % 8 WHEN 0 THEN concat('make[1]: Entering directory ''/build/d', p_size % 5, '''') WHEN 1 THEN concat('gcc -c -O2 -Wall -DX=', p_size, ' -I include -o f', p_partkey, '.o f', p_partkey, '.c')
  WHEN 2 THEN concat('ar rc lib', p_size, '.a f', p_partkey - 1, '.o f', p_partkey - 9, '.o && ranlib lib', p_size, '.a') WHEN 3 THEN concat('cd sub', p_size % 3, '; gcc -shared -Wl,-soname,libz.so -o out', p_size, '.so a.o ../b.o')
  WHEN 4 THEN concat('/usr/bin/libtool --mode=link gcc -o libq', p_size, '.la x.lo y', p_size % 7, '.lo -rpath /usr/lib') WHEN 5 THEN 'gcc -std=c9x -c -MF dep.d {slash}'
  WHEN 6 THEN concat('   -o z', p_partkey, '.o z', p_partkey, '.c') ELSE concat('ld -T script -o kern', p_size, ' a.o b.o > log') END"""
#: The same text for both; a log for each brand, in the order of the parts.
_SQL_LINES = "bl AS (SELECT 'log' || (p_partkey // 80) AS file, p_partkey AS line_no, " + _LINE.replace("{slash}", "\\") + " AS line FROM part)"


def _lines(spark, d):
    return B.table(spark, d, "part").select(F.expr("concat('log', p_partkey div 80)").alias("file"), F.col("p_partkey").alias("line_no"), F.expr(_LINE.replace("{slash}", "\\\\")).alias("line"))


_JOINED = """jl AS (SELECT file, min(line_no) AS line_no, CASE WHEN count(*) > 1 THEN replace(string_agg(line, ' ' ORDER BY line_no), chr(92), ' ') ELSE min(line) END AS line
  FROM (SELECT *, sum(CASE WHEN coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line_no) AS part FROM (SELECT *, lag(ends_with(rtrim(line), chr(92))) OVER (PARTITION BY file ORDER BY line_no) AS before FROM bl)) GROUP BY file, part)"""


@query("log_continuation", f"WITH {_SQL_LINES}, {_JOINED} SELECT file, line_no, line FROM jl")
def log_continuation(spark, d):
    return L.joined_lines(_lines(spark, d))


def commands_of(spark, d):
    return L.commands(L.joined_lines(_lines(spark, d)))


_SPLIT = r"""cs AS (SELECT file, line_no, [split_part(c, ' >', 1) for c in string_split_regex(line, '&&|;|\|') if c <> ''] AS cs FROM jl), cm AS (SELECT file, line_no, generate_subscripts(cs, 1) - 1 AS part, unnest(cs) AS command FROM cs),
  tk AS (SELECT file, line_no, part, [t for t in string_split(command, ' ') if t <> ''] AS words FROM cm)"""


@query("cmd_split", f"WITH {_SQL_LINES}, {_JOINED}, {_SPLIT} SELECT file, line_no, part, array_to_string(words, ' ') AS words FROM tk")
def cmd_split(spark, d):
    return commands_of(spark, d).select("file", "line_no", F.col("part").cast("long").alias("part"), F.array_join("words", " ").alias("words"))


_KIND = """CASE WHEN list_has_any(string_split_regex(words[1], '[/\\\\]'), ['cc', 'gcc', 'g++', 'c++']) THEN 'cc' WHEN list_has_any(string_split_regex(words[1], '[/\\\\]'), ['ar']) THEN 'ar' WHEN words[1] = 'cd' THEN 'cd'
  WHEN list_has_any(string_split_regex(words[1], '[/\\\\]'), ['libtool']) THEN 'libtool' WHEN starts_with(words[1], 'make') AND contains(array_to_string(words, ' '), 'Entering directory') THEN 'entering' WHEN words[1] = 'ld' THEN 'ld' END"""


@query("cmd_classify", f"WITH {_SQL_LINES}, {_JOINED}, {_SPLIT} SELECT file, line_no, part, {_KIND} AS kind FROM tk")
def cmd_classify(spark, d):
    return commands_of(spark, d).select("file", "line_no", F.col("part").cast("long").alias("part"), "kind")


@query("flag_filter", f"""WITH {_SQL_LINES}, {_JOINED}, {_SPLIT} SELECT file, line_no, part, array_to_string([words[i] for i in range(1, len(words) + 1) if NOT regexp_matches(words[i], '^(-I|-l|-L|-O|-f|-g|-p|-std|-D|-W([^l]|$))')
  AND words[i] NOT IN ('-rpath', '-MF') AND NOT (i > 1 AND words[greatest(i - 1, 1)] IN ('-rpath', '-MF'))], ' ') AS words FROM tk""")
def flag_filter(spark, d):
    return commands_of(spark, d).select("file", "line_no", F.col("part").cast("long").alias("part"), F.array_join(L.useful_tokens(F.col("words")), " ").alias("words"))


@query("std_canonical", f"""WITH {_SQL_LINES}, {_JOINED}, {_SPLIT} SELECT file, line_no, part, array_to_string([CASE WHEN words[i] = '-I' THEN '-I' || words[i + 1] WHEN words[i] = '-std=c9x' THEN '-std=c99' ELSE words[i] END for i in range(1, len(words) + 1)
  if regexp_matches(words[i], '^-[DLI]|^-std')], ' ') AS options FROM tk""")
def std_canonical(spark, d):
    return commands_of(spark, d).select("file", "line_no", F.col("part").cast("long").alias("part"), F.array_join(L.compile_options(F.col("words")), " ").alias("options"))


_CWD = f"""kd AS (SELECT *, {_KIND} AS kind, row_number() OVER (PARTITION BY file ORDER BY line_no, part) AS r FROM tk),
  mv AS (SELECT *, CASE kind WHEN 'entering' THEN substr(words[4], 2, length(words[4]) - 2) END AS entered, CASE kind WHEN 'cd' THEN words[2] END AS moved FROM kd),
  sg AS (SELECT *, coalesce(sum(CASE WHEN entered IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM mv),
  cw AS (SELECT s.file, s.line_no, s.part, s.kind, s.words, coalesce((SELECT max_by(entered, r) FROM mv e WHERE e.file = s.file AND e.r < s.r AND e.entered IS NOT NULL), '/w') AS base,
    (SELECT string_agg('/' || moved, '' ORDER BY r) FROM sg e WHERE e.file = s.file AND e.r < s.r AND e.since = s.since AND e.moved IS NOT NULL) AS sub FROM sg s)"""


@query("cwd_tracking", f"WITH {_SQL_LINES}, {_JOINED}, {_SPLIT}, {_CWD} SELECT file, line_no, part, base || coalesce(sub, '') AS cwd FROM cw")
def cwd_tracking(spark, d):
    return L.with_cwd(commands_of(spark, d), F.lit("/w")).select("file", "line_no", F.col("part").cast("long").alias("part"), "cwd")


def parsed_of(spark, d):
    return L.parsed_commands(L.with_cwd(commands_of(spark, d), F.lit("/w")))


@query("parsed_commands", f"""WITH {_SQL_LINES}, {_JOINED}, {_SPLIT}, {_CWD}, c AS (SELECT *, base || coalesce(sub, '') AS cwd FROM cw WHERE kind IN ('cc', 'ar', 'libtool', 'ld')),
  p AS (SELECT file, line_no, cwd, kind, words, CASE kind WHEN 'ar' THEN words[3] WHEN 'ld' THEN words[5] WHEN 'libtool' THEN replace(words[5], '.la', '.a') ELSE words[list_position(words, '-o') + 1] END AS o,
    CASE kind WHEN 'ar' THEN words[4:] WHEN 'ld' THEN words[6:] WHEN 'libtool' THEN [replace(t, '.lo', '.o') for t in words[6:7]] ELSE words[list_position(words, '-o') + 2:] END AS i FROM c)
  SELECT file, line_no, cwd || '/' || o AS output, array_to_string([CASE WHEN starts_with(t, '../') THEN regexp_replace(cwd, '/[^/]*$', '') || substr(t, 3) ELSE cwd || '/' || t END for t in i], ' ') AS dependency,
    NOT (kind = 'cc' AND len(i) = 1) AS is_elf, kind IN ('ar', 'ld', 'libtool') OR contains(array_to_string(words, ' '), 'soname') AS needed FROM p""")
def parsed_commands(spark, d):
    return parsed_of(spark, d).select("file", "line_no", "output", F.array_join("dependency", " ").alias("dependency"), "is_elf", "needed")


@query("dependency_closure", """WITH RECURSIVE e AS (SELECT p_partkey // 2 AS output, p_partkey AS dependency FROM part WHERE p_partkey > 0 AND p_partkey // 2 > 0), r(output, dependency) AS (SELECT * FROM e UNION SELECT r.output, e.dependency FROM r JOIN e ON r.dependency = e.output)
  SELECT output, dependency FROM r""")
def dependency_closure(spark, d):
    edges = B.table(spark, d, "part").selectExpr("p_partkey div 2 AS output", "p_partkey AS dependency").where("output > 0 AND dependency > 0")
    return G.closure(edges)


@query("sources_of_outputs", """WITH RECURSIVE cmd AS (SELECT p_partkey AS k, p_partkey % 3 <> 0 AS is_elf FROM part WHERE p_partkey > 0), e AS (SELECT p_partkey // 2 AS o, p_partkey AS dep FROM part WHERE p_partkey > 1),
  r(o, dep) AS (SELECT * FROM e UNION SELECT r.o, e.dep FROM r JOIN e ON r.dep = e.o JOIN cmd c ON c.k = r.dep AND c.is_elf) SELECT 'o' || r.o AS output, count(DISTINCT dep) AS n FROM r JOIN cmd a ON a.k = r.o AND a.is_elf JOIN cmd b ON b.k = dep AND NOT b.is_elf GROUP BY 1""")
def sources_of_outputs(spark, d):
    """Outputs in a tree of which every third is an object of one source: how many sources each flattens to."""
    part = B.table(spark, d, "part").select("p_partkey")
    inner = part.where("p_partkey > 1").selectExpr("p_partkey div 2 AS k", "concat('o', p_partkey) AS dep").where("k % 3 <> 0")
    elf = inner.groupBy("k").agg(F.collect_list("dep").alias("dependency")).selectExpr("concat('o', k) AS output", "dependency", "true AS is_elf")
    objects = part.where("p_partkey > 0 AND p_partkey % 3 = 0").selectExpr("concat('o', p_partkey) AS output", "array(concat('s', p_partkey, '.c')) AS dependency", "false AS is_elf")
    return G.sources_of_outputs(elf.unionByName(objects)).select("output", F.size("sources").cast("long").alias("n"))


@query("source_set_dedupe", """WITH s AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey % 40)), ',') AS m FROM lineitem GROUP BY 1) SELECT min(l_orderkey) AS l_orderkey, m AS members FROM s GROUP BY m""")
def source_set_dedupe(spark, d):
    rows = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 40).alias("members"))
    out = V.first_of_equal_sets(rows, "l_orderkey", "members")
    return out.select("l_orderkey", F.array_join(F.array_sort(F.array_distinct("members")).cast("array<string>"), ",").alias("members"))


@query("option_join", """WITH l AS (SELECT p_partkey AS line_no, 'gcc -DV=' || p_size || ' -c src/d' || (p_partkey % 3) || '/f' || (p_partkey % 200) || '.c' AS line, 'd' || (p_partkey % 3) || '/f' || (p_partkey % 200) || '.c' AS p, 'f' || (p_partkey % 200) || '.c' AS n, '-DV=' || p_size AS o FROM part),
  s AS (SELECT DISTINCT 'd' || (p_partkey % 4) || '/f' || (p_partkey % 250) || '.c' AS source, 'f' || (p_partkey % 250) || '.c' AS n FROM part), w AS (SELECT source, max_by(o, line_no) AS o FROM s JOIN l ON source = p GROUP BY 1), b AS (SELECT source, s.n, max_by(o, line_no) AS o FROM s JOIN l ON s.n = l.n GROUP BY ALL)
  SELECT source, CASE WHEN w.o IS NOT NULL THEN source ELSE '-' || b.n END AS key, coalesce(w.o, b.o) AS options FROM b LEFT JOIN w USING (source)""")
def option_join(spark, d):
    part = B.table(spark, d, "part")
    lines = part.selectExpr("p_partkey AS line_no", "concat('gcc -DV=', p_size, ' -c src/d', p_partkey % 3, '/f', p_partkey % 200, '.c') AS line")
    sources = part.selectExpr("concat('d', p_partkey % 4, '/f', p_partkey % 250, '.c') AS source").distinct()
    return L.options_by_source(lines, sources).select("source", "key", F.array_join("options", " ").alias("options"))


@query("root_score", """WITH f AS (SELECT 'dir' || (p_partkey % 97) AS dir, CASE p_size % 6 WHEN 0 THEN 'README' WHEN 1 THEN 'Makefile' WHEN 2 THEN 'main.c' WHEN 3 THEN 'configure' WHEN 4 THEN 'ChangeLog' ELSE 'x.h' END AS name FROM part)
  SELECT dir, count(*) FILTER (lower(name) IN ('readme', 'makefile', 'configure', 'changelog')) AS score FROM f GROUP BY dir""")
def root_score(spark, d):
    files = B.table(spark, d, "part").selectExpr("concat('dir', p_partkey % 97) AS dir", "CASE p_size % 6 WHEN 0 THEN 'README' WHEN 1 THEN 'Makefile' WHEN 2 THEN 'main.c' WHEN 3 THEN 'configure' WHEN 4 THEN 'ChangeLog' ELSE 'x.h' END AS name")
    return L.root_scores(files)


@query("unique_basename", "SELECT name, min(path) AS path FROM (SELECT 'f' || (p_partkey % 1500) || '.c' AS name, '/r/d' || (p_partkey % 7) || '/f' || (p_partkey % 1500) || '.c' AS path FROM part) GROUP BY name HAVING count(*) = 1")
def unique_basename(spark, d):
    return L.unique_basenames(B.table(spark, d, "part").selectExpr("concat('/r/d', p_partkey % 7, '/f', p_partkey % 1500, '.c') AS path"))


@query("path_normalize", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/a/b' || p_size WHEN 1 THEN '/w/x/c' || p_size || '.o' WHEN 2 THEN '/w/.libs/q.a' ELSE '/w/m.o' END AS path FROM part")
def path_normalize(spark, d):
    path = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('/a//./z/../b', p_size) WHEN 1 THEN concat('./x/y/../c', p_size, '.lo') WHEN 2 THEN '.libs/.libs/q.la' ELSE '../w/m.o' END")
    return B.table(spark, d, "part").select("p_partkey", L.absolute_path(path, F.lit("/w"), True).alias("path"))


@query("symbol_table_parse", "SELECT 'obj' || (p_partkey // 100) AS file, replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey % 100 >= 5 AND p_partkey % 3 <> 0 AND p_partkey % 7 <> 0")
def symbol_table_parse(spark, d):
    line = F.expr("""CASE WHEN p_partkey % 100 = 4 THEN 'DYNAMIC SYMBOL TABLE:' WHEN p_partkey % 3 = 0 THEN concat('0000 l  .text ', p_name) WHEN p_partkey % 7 = 0 THEN concat('0000 g .hidden .text ', p_name) ELSE concat('0000 g F .text ', replace(p_name, ' ', '_')) END""")
    return L.symbol_table(B.table(spark, d, "part").select(F.expr("concat('obj', p_partkey div 100)").alias("file"), F.col("p_partkey").alias("line_no"), line.alias("line")))


@query("needed_outputs", """WITH c AS (SELECT 'log' || (p_partkey % 50) AS file, 'o' || p_partkey AS output, p_partkey % 3 <> 0 AS is_elf, (p_partkey % 50) % 2 = 0 AND p_size % 5 = 0 AS needed FROM part), a AS (SELECT file, bool_or(needed) AS any_ FROM c GROUP BY file)
  SELECT DISTINCT file, output, CAST(substr(output, 2) AS BIGINT) % 7 = 0 AS is_resolved FROM c JOIN a USING (file) WHERE CASE WHEN any_ THEN needed ELSE is_elf END""")
def needed_outputs(spark, d):
    part = B.table(spark, d, "part")
    commands = part.selectExpr("concat('log', p_partkey % 50) AS file", "concat('o', p_partkey) AS output", "p_partkey % 3 <> 0 AS is_elf", "(p_partkey % 50) % 2 = 0 AND p_size % 5 = 0 AS needed")
    return G.needed_outputs(commands, part.where("p_partkey % 7 = 0").selectExpr("concat('o', p_partkey) AS output"))


@query("inferred_objects", """SELECT '/r/d' || (p_partkey % 9) || CASE WHEN p_partkey % 4 = 1 THEN '/.libs' ELSE '' END || '/f' || p_partkey || '.o' AS path,
  CASE WHEN p_partkey % 4 = 2 THEN '/r/d' || (p_partkey % 9) || '/sub/f' || p_partkey || '.cc' ELSE '/r/d' || (p_partkey % 9) || '/f' || p_partkey || '.c' END AS source FROM part WHERE p_partkey % 4 <> 3""")
def inferred_objects(spark, d):
    part = B.table(spark, d, "part")
    missing = part.selectExpr("concat('/r/d', p_partkey % 9, CASE WHEN p_partkey % 4 = 1 THEN '/.libs' ELSE '' END, '/f', p_partkey, '.o') AS path")
    files = part.where("p_partkey % 4 <> 3").selectExpr("CASE WHEN p_partkey % 4 = 2 THEN concat('/r/d', p_partkey % 9, '/sub/f', p_partkey, '.cc') ELSE concat('/r/d', p_partkey % 9, '/f', p_partkey, '.c') END AS path")
    return G.inferred_objects(missing, files)
