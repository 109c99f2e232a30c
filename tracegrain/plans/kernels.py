"""Queries of the scalar kernels, each over all distinct inputs of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoding as E
from ..functions import lexical as L
from . import bindings as B
from .registry import query


def sql_word_weight(w: str, library: str | None = None) -> str:
    tail = f"substr({w}, 2)"
    parts = [
        (rf"regexp_matches({w}, '^\p{{L}}+$')", 0.1),
        (rf"regexp_matches({w}, '\p{{Ll}}') AND NOT regexp_matches({w}, '[\p{{Lu}}\p{{Lt}}]')", 0.1),
        (rf"regexp_matches({tail}, '\p{{Lu}}') AND NOT regexp_matches({tail}, '[\p{{Ll}}\p{{Lt}}]')", 0.25),
        (rf"regexp_matches({w}, '[0-9]')", 0.25),
        (rf"regexp_matches({w}, '[^\p{{L}}\p{{N}}]')", 0.5),
        (rf"regexp_matches({tail}, '[a-z]') AND regexp_matches({tail}, '[A-Z]')", 0.5),
        (rf"regexp_matches({w}, '{L.WEB_NAME}')", 1.0),
    ]
    if library:
        parts.append((f"contains({w}, {library})", 5.0))
    return "(" + " + ".join(f"CASE WHEN {test} THEN CAST({weight} AS DOUBLE) ELSE 0 END" for test, weight in parts) + ")"


def sql_string_weight(s: str) -> str:
    return f"(CASE WHEN contains({s}, ' ') THEN list_sum([{sql_word_weight('t')} for t in string_split({s}, ' ')]) * 1.1 ELSE {sql_word_weight(s)} END)"


_LINES = "SELECT DISTINCT unnest(string_split(text, chr(10))) AS value FROM documents"
_WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS value FROM documents"


def _lines(spark, d):
    return B.table(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value")).distinct()


def _words(spark, d):
    return B.table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("value")).distinct()


@query("lexical_weight_v1", f"""SELECT value, round(CASE WHEN contains(value, ' ') THEN list_sum([{sql_word_weight("t", "'tion'")} for t in string_split(value, ' ')]) * (1 + len(string_split(value, ' ')) * 0.1)
  ELSE {sql_word_weight("value", "'tion'")} END, 6) AS weight FROM ({_LINES})""")
def lexical_weight_v1(spark, d):
    v = F.col("value")
    return _lines(spark, d).select("value", F.round(L.line_weight(v, F.lit("tion")), 6).alias("weight"))


@query("lexical_weight_v2", f"SELECT value, round({sql_string_weight('value')}, 6) AS weight FROM ({_LINES})")
def lexical_weight_v2(spark, d):
    return _lines(spark, d).select("value", F.round(L.string_weight(F.col("value")), 6).alias("weight"))


@query("web_name", f"SELECT page_id, regexp_matches(url, '{L.WEB_NAME}') AS by_url, regexp_matches(html, '{L.WEB_NAME}') AS by_html FROM pages")
def web_name(spark, d):
    return B.table(spark, d, "pages").select("page_id", L.is_web_name(F.col("url")).alias("by_url"), L.is_web_name(F.col("html")).alias("by_html"))


@query("ordinary_word", rf"""SELECT value, regexp_matches(value, '^\p{{L}}+$') AND ((regexp_matches(value, '\p{{Ll}}') AND NOT regexp_matches(value, '[\p{{Lu}}\p{{Lt}}]'))
  OR regexp_matches(value, '^[\p{{Lu}}\p{{Lt}}][^\p{{Lu}}\p{{Lt}}]*$')) AS ordinary FROM ({_WORDS})""")
def ordinary_word(spark, d):
    return _words(spark, d).select("value", L.is_ordinary_word(F.col("value")).alias("ordinary"))


@query("unquote", """WITH l AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '"' || p_name || '"' WHEN 1 THEN 'L"' || p_name || '"' WHEN 2 THEN '"' || p_name WHEN 3 THEN '?' || p_name ELSE p_name END AS s FROM part)
  SELECT p_partkey, CASE WHEN starts_with(s, '"') AND ends_with(s, '"') THEN substr(s, 2, length(s) - 2) WHEN starts_with(s, 'L"') AND ends_with(s, '"') THEN substr(s, 3, length(s) - 3)
  WHEN starts_with(s, '"') THEN substr(s, 2) ELSE s END AS value, starts_with(s, '?') OR starts_with(s, '.?') AS mangled FROM l""")
def unquote(spark, d):
    literal = F.expr("""CASE p_partkey % 5 WHEN 0 THEN concat('"', p_name, '"') WHEN 1 THEN concat('L"', p_name, '"') WHEN 2 THEN concat('"', p_name) WHEN 3 THEN concat('?', p_name) ELSE p_name END""")
    rows = B.table(spark, d, "part").select("p_partkey", literal.alias("s"))
    return rows.select("p_partkey", L.unquoted(F.col("s")).alias("value"), L.is_mangled(F.col("s")).alias("mangled"))


@query("run_length_entropy", """WITH b AS (SELECT o_orderkey, bin(o_orderkey) AS bits FROM orders), r AS (SELECT o_orderkey, bits, [length(x) for x in regexp_extract_all(bits, '0+|1+')] AS runs FROM b)
  SELECT o_orderkey, array_to_string(runs, ',') AS runs, round(coalesce(list_sum([x / power(2.0, x) for x in runs if x <= 10]), 0), 6) AS entropy FROM r""")
def run_length_entropy(spark, d):
    bits = F.bin("o_orderkey")
    runs = F.array_join(E.run_lengths(bits).cast("array<string>"), ",")
    return B.table(spark, d, "orders").select("o_orderkey", runs.alias("runs"), F.round(E.bit_entropy(bits), 6).alias("entropy"))


_SQL_REVERSED = "array_to_string(list_reverse(regexp_extract_all(CASE WHEN length({0}) % 2 = 1 THEN substr({0}, 2) ELSE {0} END, '..')), '')"


def sql_little_endian(digits: str, width: str) -> str:
    return _SQL_REVERSED.format(f"(CASE WHEN length({digits}) < {width} + {width} % 2 THEN lpad({digits}, CAST({width} + {width} % 2 AS INTEGER), '0') ELSE {digits} END)")


def sql_packed(value: str, width: str) -> str:
    """Numbers that are not negative."""
    return sql_little_endian(f"lower(to_hex({value}))", width)


@query("little_endian", f"SELECT o_orderkey, {', '.join(f'{sql_packed('o_orderkey * 37', str(w))} AS w{w}' for w in (2, 3, 8, 16))} FROM orders")
def little_endian(spark, d):
    digits = F.lower(F.hex(F.col("o_orderkey") * 37))
    return B.table(spark, d, "orders").select("o_orderkey", *(E.little_endian(digits, F.lit(w)).alias(f"w{w}") for w in (2, 3, 8, 16)))


@query("pack_widths", f"""WITH {B.SQL_ARRAYS}, s AS (SELECT o_orderkey, [x * 9 - 60 for x in arr] AS arr FROM na)
  SELECT o_orderkey, array_to_string([array_to_string([{sql_little_endian("substr(printf('%016x', x), 17 - w, w)", "w")} for x in arr], '') for w in [2, 4, 8, 16]
    if w = 16 OR (power(16, w) > list_max(arr) AND power(16, w) / 2 > -list_min(arr))], '|') AS needles FROM s""")
def pack_widths(spark, d):
    arr = F.transform("arr", lambda x: x * 9 - 60)
    return B.order_arrays(spark, d).select("o_orderkey", F.array_join(E.needles(arr), "|").alias("needles"))


@query("literal_to_int", """WITH l AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '0x' || to_hex(p_partkey) || 'uL' WHEN 1 THEN to_hex(p_partkey) || 'h' WHEN 2 THEN p_partkey || 'UL' WHEN 3 THEN '0' || p_partkey WHEN 4 THEN '-' || p_partkey
    WHEN 5 THEN 'FF' || p_partkey ELSE p_name END AS s FROM part),
  c AS (SELECT p_partkey, s, regexp_replace(s, '[hH]', ' ', 'g') AS hx, regexp_replace(s, '[uUlL]', ' ', 'g') AS pl FROM l)
  SELECT p_partkey, CASE WHEN regexp_matches(s, '[hH]') THEN CASE WHEN regexp_full_match(trim(hx), '(0[xX])?[0-9A-Fa-f]+') THEN CAST('0x' || regexp_replace(trim(hx), '^0[xX]', '') AS BIGINT) END
    WHEN regexp_full_match(trim(pl), '[+-]?[0-9]+') THEN CAST(trim(pl) AS BIGINT) WHEN regexp_full_match(trim(pl), '(0[xX])?[0-9A-Fa-f]+') THEN CAST('0x' || regexp_replace(trim(pl), '^0[xX]', '') AS BIGINT) END AS value FROM c""")
def literal_to_int(spark, d):
    literal = F.expr("""CASE p_partkey % 7 WHEN 0 THEN concat('0x', hex(p_partkey), 'uL') WHEN 1 THEN concat(hex(p_partkey), 'h') WHEN 2 THEN concat(p_partkey, 'UL') WHEN 3 THEN concat('0', p_partkey)
        WHEN 4 THEN concat('-', p_partkey) WHEN 5 THEN concat('FF', p_partkey) ELSE p_name END""")
    return B.table(spark, d, "part").select("p_partkey", E.whole_number(literal).alias("value"))


@query("trie_partition", f"WITH {B.SQL_ARRAYS} SELECT o_orderkey, CASE WHEN arr[2] <= 3 THEN 1 WHEN arr[2] <= 100 THEN 2 ELSE 3 END AS trie_no FROM na")
def trie_partition(spark, d):
    return B.order_arrays(spark, d).select("o_orderkey", E.trie_number(F.col("arr")).alias("trie_no"))


_SQL_STEPS = "[arr[i + 1] - arr[i] for i in range(1, len(arr))]"


def sql_continuous(arr: str) -> str:
    steps = _SQL_STEPS.replace("arr", arr)
    return "(" + " OR ".join(f"len([x for x in {steps} if x <> {k}]) = 0" for k in (1, 0, -1)) + ")"


@query("continuous_array", f"WITH {B.SQL_ARRAYS}, d AS (SELECT o_orderkey, [x // 25 for x in arr] AS arr FROM na) SELECT o_orderkey, {sql_continuous('arr')} AS continuous FROM d")
def continuous_array(spark, d):
    arr = F.transform("arr", lambda x: F.floor(x / 25))
    return B.order_arrays(spark, d).select("o_orderkey", E.is_continuous(arr).alias("continuous"))


@query("zero_trim", f"""WITH {B.SQL_ARRAYS}, d AS (SELECT o_orderkey, [x // 20 for x in arr] AS arr FROM na), p AS (SELECT o_orderkey, arr, [i for i in range(1, len(arr) + 1) if arr[i] <> 0] AS nz FROM d)
  SELECT o_orderkey, array_to_string(CASE WHEN len(nz) = 0 THEN CAST([] AS BIGINT[]) ELSE arr[nz[1]:nz[-1]] END, ',') AS trimmed FROM p""")
def zero_trim(spark, d):
    arr = F.transform("arr", lambda x: F.floor(x / 20))
    return B.order_arrays(spark, d).select("o_orderkey", F.array_join(E.without_outer_zeros(arr).cast("array<string>"), ",").alias("trimmed"))


@query("type_width", f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}, {16 if k in E.WIDE_TYPES else v})" for k, v in E.TYPE_WIDTHS.items())}) v(ctype, w32, w64)),
  n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'static const unsigned char' WHEN 1 THEN 'const long' WHEN 2 THEN 'u32' ELSE 'static my_type' END AS declared FROM part),
  s AS (SELECT p_partkey, array_to_string([x for x in string_split(declared, ' ') if x NOT IN ('const', 'static')], ' ') AS name FROM n), td AS (SELECT 'u32' AS name, 'unsigned int' AS target)
  SELECT p_partkey, coalesce(td.target, t0.ctype) AS element_type, t.w32, t.w64 FROM s LEFT JOIN td USING (name) LEFT JOIN t t0 ON t0.ctype = s.name LEFT JOIN t ON t.ctype = coalesce(td.target, t0.ctype)""")
def type_width(spark, d):
    """A declared type without `const` and `static`, through the typedefs, else a built-in type, else null; and its widths."""
    declared = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'static const unsigned char' WHEN 1 THEN 'const long' WHEN 2 THEN 'u32' ELSE 'static my_type' END")
    rows = B.table(spark, d, "part").select("p_partkey", F.array_join(F.filter(F.split(declared, " "), lambda t: ~t.isin("const", "static")), " ").alias("name"))
    typedefs = spark.createDataFrame([("u32", "unsigned int")], "name string, target string")
    name = F.coalesce("target", F.when(F.col("name").isin(*E.TYPE_WIDTHS), F.col("name")))
    return rows.join(F.broadcast(typedefs), "name", "left").select("p_partkey", name.alias("element_type"), E.type_width(name).alias("w32"), E.type_width(name, True).alias("w64"))
