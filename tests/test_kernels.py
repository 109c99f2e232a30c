"""Kernels by hand-computed rows."""

import pytest
from pyspark.sql import functions as F

from tracegrain.functions import encoding as E
from tracegrain.functions import lexical as L


def column(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_word_weights(spark):
    words = ["", "word", "Word", "WORD", "fooBar", "a_b", "x86", "http://www.example.com/a"]
    got = column(spark, words, "string", L.word_weight)
    assert got == pytest.approx([0, 0.2, 0.1, 0.35, 0.6, 0.6, 0.35, 0.1 + 0.5 + 1])
    assert column(spark, ["zlibname"], "string", lambda c: L.word_weight(c, F.lit("zlib"))) == pytest.approx([5.2])


def test_factor_with_spaces_grows_for_lines_only(spark):
    text = ["ab cd ef"]
    assert column(spark, text, "string", lambda c: L.line_weight(c, F.lit("zz"))) == pytest.approx([0.6 * 1.3])
    assert column(spark, text, "string", L.string_weight) == pytest.approx([0.6 * 1.1])
    assert column(spark, text, "string", lambda c: L.string_weight(c, True)) == pytest.approx([0.6 * 1.3])


def test_ordinary_words_and_quotes(spark):
    assert column(spark, ["Word", "word", "WORD", "wOrd", "two words", "x1", ""], "string", L.is_ordinary_word) == [True, True, False, False, False, False, False]
    assert column(spark, ['"x"', 'L"x"', '"x', "x", '"', "L'"], "string", L.unquoted) == ["x", "x", "x", "x", "", "L'"]
    assert column(spark, ["?f", ".?f", "f?"], "string", L.is_mangled) == [True, True, False]


def test_signatures(spark):
    assert column(spark, ["f(class foo *,char const *,)", "g()"], "string", L.binary_parameters) == [["* foo", "const char *", "void"], ["void"]]
    assert column(spark, ["f(foo *p,const char *s,int)", "g()"], "string", L.source_parameters) == [["* foo", "const char *", "int"], ["void"]]


def test_little_endian(spark):
    assert column(spark, ["1", "abc", "12345"], "string", lambda c: E.little_endian(c, F.lit(4))) == ["0100", "bc0a", "4523"]
    assert column(spark, ["1"], "string", lambda c: E.little_endian(c, F.lit(3))) == ["0100"]


def test_packed_negative_numbers(spark):
    assert column(spark, [-1, -128, 255], "bigint", lambda c: E.packed(c, F.lit(2))) == ["ff", "80", "ff"]
    assert column(spark, [-2, 258], "bigint", lambda c: E.packed(c, F.lit(8))) == ["feffffff", "02010000"]


def test_widths(spark):
    arrays = [[-127, 5], [-128, 5], [255], [256], [2**62]]
    assert column(spark, arrays, "array<bigint>", lambda c: E.widths(c, True)) == [[2, 4, 8, 16], [4, 8, 16], [2, 4, 8, 16], [4, 8, 16], [16]]
    assert column(spark, [[-300, 5]], "array<bigint>", lambda c: E.widths(c, False)) == [[2, 4, 8, 16]]


def test_array_shapes(spark):
    arrays = [[1, 2, 3], [7, 7], [3, 2, 1], [1, 3], [4], [0, 1, 0, 2, 0], [0, 0]]
    assert column(spark, arrays, "array<bigint>", E.is_continuous) == [True, True, True, False, True, False, True]
    assert column(spark, arrays, "array<bigint>", E.without_outer_zeros)[-2:] == [[1, 0, 2], []]
    assert column(spark, [[1, 3], [1, 4], [1, 100], [1, 101]], "array<bigint>", E.trie_number) == [1, 2, 2, 3]


def test_bits(spark):
    assert column(spark, ["0011101", "1"], "string", E.run_lengths) == [[2, 3, 1, 1], [1]]
    assert column(spark, ["0011101", "0" * 11], "string", E.bit_entropy) == pytest.approx([2 / 4 + 3 / 8 + 1 / 2 + 1 / 2, 0])


def test_literals(spark):
    assert column(spark, ["0x1FuL", "1Fh", "12UL", "077", "-5", "FF", "zz", ""], "string", E.whole_number) == [31, 31, 12, 77, -5, 255, None, None]
