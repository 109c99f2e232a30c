"""Build logs, binaries, stored tables, streams."""

import struct

from pyspark.sql import functions as F

from tracegrain.operators import strings as S
from tracegrain.sources import binaries as P
from tracegrain.sources import buildlog as L
from tracegrain.sources import features as T
from tracegrain.streaming import probe


def executable() -> bytes:
    """A small 32-bit executable with .rdata, .data, .text and an export directory in .rdata."""
    strings = b"alpha\0beta\0"
    base, raw = 0x1000, 0x400
    directory = struct.pack("<4I2H7I", 0, 0, 0, 0, 0, 0, 0, 1, 3, 2, base + 40, base + 60, base + 80)[:-2]
    directory = struct.pack("<IIHHIIIIIII", 0, 0, 0, 0, 0, 1, 3, 2, base + 40, base + 60, base + 80)
    body = bytearray(0x200)
    body[:40] = directory
    body[60:68] = struct.pack("<II", base + 100, base + 106)
    body[80:84] = struct.pack("<HH", 0, 2)
    body[100 : 100 + len(strings)] = strings
    optional = bytearray(224)
    optional[:2] = struct.pack("<H", 0x10B)
    optional[96:104] = struct.pack("<II", base, 40)
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 3, 0, 0, 0, 224, 0) + bytes(optional)
    for name, offset, size, vaddr in ((b".rdata", raw, 0x200, base), (b".data", raw + 0x200, 8, 0x2000), (b".text", raw + 0x208, 4, 0x3000)):
        head += struct.pack("<8s4I", name, size, vaddr, size, offset).ljust(40, b"\0")
    return head.ljust(raw, b"\0") + bytes(body) + b"DATADATA" + b"code"


def test_executables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.dll").write_bytes(executable())
    (tmp_path / "a/broken.exe").write_bytes(b"MZ")
    (tmp_path / "a/y.txt").write_bytes(executable())
    files = P.read_binaries(spark, f"file://{tmp_path}")
    assert files.count() == 2
    assert {(r.seg, r.hex[:8]) for r in P.segments(files).collect()} == {(".rdata", "00000000"), (".data", "44415441")}
    assert [(r.ordinal, r.name) for r in P.exported_names(files).orderBy("ordinal").collect()] == [(1, "alpha"), (2, "None"), (3, "beta")]
    assert {r[0] for r in files.select(P.is_pe32(F.col("data"))).collect()} == {True, None}


def test_log(spark, tmp_path):
    text = "make[1]: Entering directory '/src/lib'\ngcc -c -O2 a.c \\\n  -o a.o\n\tar rc liba.a a.o b.o\ncd ../tool && gcc -o tool main.c ../lib/liba.a\n[info]\n"
    (tmp_path / "log").write_text(text)
    parsed = L.latest(L.parsed_commands(L.with_cwd(L.commands(L.joined_lines(L.read_logs(spark, f"file://{tmp_path}"))))))
    got = {r.output: (tuple(r.dependency), r.is_elf, r.needed) for r in parsed.collect()}
    assert got == {
        "/src/lib/a.o": (("/src/lib/a.c",), False, False),
        "/src/lib/liba.a": (("/src/lib/a.o", "/src/lib/b.o"), True, True),
        "/src/tool/tool": (("/src/tool/main.c", "/src/lib/liba.a"), True, False),
    }


def test_commands(spark):
    df = spark.createDataFrame([("if test x; then gcc `pwd`/a -DA=\"b c\" -MF d x.c > log | tee y",)], "line string")
    words = [r.w for r in df.select(F.explode(L.split_commands(F.col("line"))).alias("c")).select(L.tokens(F.col("c")).alias("w")).collect()]
    assert words == [["test", "x"], ["gcc", "/a", '-DA="b c"', "-MF", "d", "x.c"], ["tee", "y"]]
    kept = spark.createDataFrame([(words[1],)], "w array<string>").select(L.useful_tokens(F.col("w")), L.compile_options(F.col("w"))).first()
    assert kept[0] == ["gcc", "/a", "x.c"] and kept[1] == ['-DA="b c"']


def test_needed_tables():
    assert T.needed_tables(["export"]) == ["export", "func_name"]
    assert T.needed_tables(["export", "string"], "binary") == ["export_func", "hard_string"]


def test_index_round_trip_prunes(spark, tmp_path):
    rows = spark.createDataFrame([([1, 2], 1), ([1, 50], 2), ([1, 500], 3)], "arr array<bigint>, trie_no int")
    T.write_index(rows, f"file://{tmp_path}/i")
    read = T.read_index(spark, f"file://{tmp_path}/i", 2)
    assert [r.arr for r in read.collect()] == [[1, 50]]
    assert "PartitionFilters: [isnotnull(trie_no" in read._jdf.queryExecution().executedPlan().toString()


def test_stream_counts_a_string_once(spark, tmp_path):
    source = spark.createDataFrame([("p", "d", "1", f"str_{i}") for i in range(5)] + [("q", "d", "1", "other_1")], "pj string, dyn string, ver string, value string")
    index = S.string_index(source, source.select("pj", "ver")).cache()
    schema = "bin_file string, value string"
    for k, values in enumerate((["str_0", "str_1", "str_1"], ["str_1", "nothing", "other_1"])):
        spark.createDataFrame([("b", v) for v in values], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        strings = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        probe.append_scores(strings, index, f"file://{tmp_path}/out", f"file://{tmp_path}/check", availableNow=True).awaitTermination()
    got = {(r.pj, r.matched_count) for r in probe.scores_so_far(spark.read.parquet(f"file://{tmp_path}/out")).collect()}
    assert got == {("p", 2), ("q", 1)}


def test_entry_without_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tracegrain", tmp_path / "tracegrain", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'string_match_index' in q and not [n for n in q if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
