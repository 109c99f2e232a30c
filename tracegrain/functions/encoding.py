"""How numbers lie in a binary: little-endian hex, widths, runs of bits; and which arrays are worth looking for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths of a number in hex digits.
WIDTHS = (2, 4, 8, 16)
#: Hex digits of C types on 32-bit machines; `long` and `unsigned long` are twice as wide on 64-bit ones.
TYPE_WIDTHS = {
    "byte": 2, "char": 2, "int": 8, "short": 4, "long": 8, "unsigned int": 8, "unsigned short": 4, "unsigned long": 8,
    "long long": 16, "bool": 2, "unsigned char": 2, "float": 8, "double": 16, "__int8": 2, "__int16": 4, "__int32": 8,
    "__int64": 16, "long double": 16, "wchar_t": 4,
}
WIDE_TYPES = ("long", "unsigned long")
#: Arrays shorter than this, of less entropy, or of as many projects say too little.
LEAST_LENGTH, LEAST_ENTROPY, MOST_PROJECTS = 4, 10, 10


def type_width(name: Column, wide: bool = False) -> Column:
    """Hex digits of a C type, null if it is not known."""
    table = {k: 16 if wide and k in WIDE_TYPES else v for k, v in TYPE_WIDTHS.items()}
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[name]


def little_endian(digits: Column, width: Column) -> Column:
    """Hex ``digits`` filled up with zeros to an even ``width``, bytes reversed. Longer ones are not cut, but an odd
    first digit is lost."""
    width = width + width % 2
    filled = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    even = F.when(F.length(filled) % 2 == 1, F.substring(filled, F.lit(2), F.length(filled))).otherwise(filled)
    return F.array_join(F.reverse(F.regexp_extract_all(even, F.lit("(..)"), 1)), "")


def packed(value: Column, width: Column) -> Column:
    """A whole number as little-endian hex of ``width`` digits; negative ones in two's complement."""
    digits = F.lower(F.hex(value))
    cut = F.when(value < 0, F.substring(digits, 17 - width, width)).otherwise(digits)
    return little_endian(cut, width)


def _bound(width: Column) -> Column:
    """16 ** width, null where it is beyond 64 bits."""
    return F.when(width == 2, F.lit(1 << 8).cast("long")).when(width == 4, F.lit(1 << 16).cast("long")).when(width == 8, F.lit(1 << 32))


def _fits(width: Column, high: Column) -> Column:
    """16 ** width > high, for whole numbers of 64 bits."""
    return _bound(width).isNull() | (_bound(width) > high)


def _fits_signed(width: Column, low: Column) -> Column:
    """16 ** width / 2 > -low: the smallest number of a width does not fit it."""
    return _bound(width).isNull() | (_bound(width) / 2 > -low)


def widths(arr: Column, signed: bool) -> Column:
    """Widths in which an array of unknown type may lie; ``signed`` looks at its smallest number too."""
    every = F.array(*(F.lit(w) for w in WIDTHS))
    high, low = F.array_max(arr), F.array_min(arr)
    return F.filter(every, lambda w: _fits(w, high) & (_fits_signed(w, low) if signed else F.lit(True)))


def needle(arr: Column, width: Column) -> Column:
    """An array as hex, each number of the same width."""
    return F.array_join(F.transform(arr, lambda x: packed(x, width)), "")


def needles(arr: Column, signed: bool = True) -> Column:
    return F.transform(widths(arr, signed), lambda w: needle(arr, w))


def run_lengths(bits: Column) -> Column:
    return F.transform(F.regexp_extract_all(bits, F.lit("(0+|1+)"), 1), lambda r: F.length(r))


def bit_entropy(bits: Column) -> Column:
    """Sum of l / 2**l over runs of at most ten."""
    short = F.filter(run_lengths(bits), lambda n: n <= 10)
    return F.aggregate(short, F.lit(0.0), lambda a, n: a + n / F.pow(F.lit(2.0), n))


def trie_number(arr: Column) -> Column:
    """The partition of the array index, by the second number."""
    second = F.try_element_at(arr, F.lit(2))
    return F.when(second <= 3, 1).when(second <= 100, 2).otherwise(3)


def is_continuous(arr: Column) -> Column:
    """All neighbours differ by 1, by 0 or by -1; so does an array of one."""
    steps = F.zip_with(F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 1, F.lit(0))), F.slice(arr, F.lit(1), F.greatest(F.size(arr) - 1, F.lit(0))), lambda b, a: b - a)
    return F.forall(steps, lambda d: d == 1) | F.forall(steps, lambda d: d == 0) | F.forall(steps, lambda d: d == -1)


def without_outer_zeros(arr: Column) -> Column:
    marks = F.transform(arr, lambda x: F.when(x != 0, 1).otherwise(0))
    first = F.array_position(marks, 1)
    last = F.size(arr) + 1 - F.array_position(F.reverse(marks), 1)
    none = (F.try_element_at(arr, F.lit(1)) != 0) & (F.try_element_at(arr, F.lit(-1)) != 0)
    return F.when(none, arr).when(first == 0, F.slice(arr, 1, 0)).otherwise(F.slice(arr, first.cast("int"), (last - first + 1).cast("int")))


def is_admitted(arr: Column, entropy: Column, projects: Column) -> Column:
    """Whether the index takes an array."""
    return (F.size(arr) >= LEAST_LENGTH) & (entropy >= LEAST_ENTROPY) & (projects < MOST_PROJECTS) & ~is_continuous(arr)


def is_searchable(arr: Column) -> Column:
    return (F.size(arr) >= 3) & F.exists(arr, lambda x: x != 0)


def whole_number(literal: Column) -> Column:
    """A C literal's value: `h` marks hex, suffixes u and l go, decimal before hex; leading zeros do not make it octal."""
    hexed = F.regexp_replace(literal, "[hH]", " ")
    plain = F.regexp_replace(literal, "[uUlL]", " ")
    of_hex = lambda s: F.conv(F.regexp_replace(F.trim(s), "^0[xX]", ""), 16, 10).try_cast("long")
    is_hex = lambda s: F.trim(s).rlike("^(0[xX])?[0-9A-Fa-f]+$")
    return (
        F.when(literal.rlike("[hH]"), F.when(is_hex(hexed), of_hex(hexed)))
        .when(F.trim(plain).rlike("^[+-]?[0-9]+$"), F.trim(plain).try_cast("long"))
        .when(is_hex(plain), of_hex(plain))
    )
