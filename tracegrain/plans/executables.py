"""Queries of binaries as tables: small executables are made of the parts, half of them 64-bit, a quarter no executable."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import binaries as E
from . import bindings as B
from .registry import query


def executables(spark, d):
    """path, data: two sections, `.rdata` with a part's key and `.data` (`.text` for a third) with its size."""
    words = {
        "mark": "CASE p_partkey % 4 WHEN 3 THEN '0000' ELSE '4D5A' END", "zeros": "repeat('00', 58)", "start": "'40000000'", "signature": "'50450000'",
        "machine": "CASE p_partkey % 4 WHEN 0 THEN '4C01' WHEN 1 THEN '6486' ELSE '0000' END", "header": "concat('0200', repeat('00', 16))",
        "first": "concat('2E72646174610000', '04000000', '00100000', '04000000', 'A8000000', repeat('00', 16))",
        "second": "concat(CASE p_partkey % 3 WHEN 0 THEN '2E74657874000000' ELSE '2E64617461000000' END, '06000000', '00200000', '06000000', 'AC000000', repeat('00', 16))",
        "key": "lpad(hex(p_partkey), 8, '0')", "size": "lpad(hex(p_size), 12, '0')",
    }
    return B.table(spark, d, "part").selectExpr("concat('f', p_partkey) AS path", f"unhex(concat({', '.join(words.values())})) AS data")


@query("pe_bitness", "SELECT 'f' || p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_32 FROM part")
def pe_bitness(spark, d):
    return executables(spark, d).select("path", E.is_pe32(F.col("data")).alias("is_32"))


@query("pe_segments", """SELECT 'f' || p_partkey AS bin_file, '.rdata' AS seg, lower(lpad(to_hex(p_partkey), 8, '0')) AS hex FROM part WHERE p_partkey % 4 <> 3
  UNION ALL SELECT 'f' || p_partkey, '.data', lower(lpad(to_hex(p_size), 12, '0')) FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 3 <> 0""")
def pe_segments(spark, d):
    return E.segments(executables(spark, d))


@query("file_hex", "SELECT doc_id, lower(hex(encode(text))) AS hex FROM documents")
def file_hex(spark, d):
    return B.table(spark, d, "documents").select("doc_id", E.as_hex(F.encode("text", "UTF-8")).alias("hex"))
