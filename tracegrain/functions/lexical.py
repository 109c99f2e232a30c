"""Lexical evidence of strings: how telling a word or a line is. All are Column expressions that stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a web address.
WEB_NAME = r"((https)?|ftp|file)(://)?(www.)[-A-Za-z0-9+&@#/%?=~_|!:,.;]+[-A-Za-z0-9+&@#/%=~_|]"


def is_web_name(s: Column) -> Column:
    return s.rlike(WEB_NAME)


def is_mixed_case(s: Column) -> Column:
    """Latin letters of both cases, as in function names."""
    return s.rlike("[a-z]") & s.rlike("[A-Z]")


def is_alpha(s: Column) -> Column:
    return s.rlike(r"^\p{L}+$")


def is_lower(s: Column) -> Column:
    """A cased character, and none in upper or title case."""
    return s.rlike(r"\p{Ll}") & ~s.rlike(r"[\p{Lu}\p{Lt}]")


def is_upper(s: Column) -> Column:
    return s.rlike(r"\p{Lu}") & ~s.rlike(r"[\p{Ll}\p{Lt}]")


def has_special(s: Column) -> Column:
    """Anything but letters and digits; the underscore counts."""
    return s.rlike(r"[^\p{L}\p{N}]")


def is_ordinary_word(s: Column) -> Column:
    """A dictionary word, which says nothing about its origin: letters only, all lower or in title case."""
    return is_alpha(s) & (is_lower(s) | s.rlike(r"^[\p{Lu}\p{Lt}][^\p{Lu}\p{Lt}]*$"))


def word_weight(s: Column, library: Column | None = None) -> Column:
    """Weight of a word; a library's name inside it counts most. The empty word weighs nothing."""
    tail = F.substring(s, 2, 1_000_000_000)
    parts = [
        (is_alpha(s), 0.1), (is_lower(s), 0.1), (is_upper(tail), 0.25), (s.rlike("[0-9]"), 0.25),
        (has_special(s), 0.5), (is_mixed_case(tail), 0.5), (is_web_name(s), 1.0),
    ]
    if library is not None:
        parts.append((s.contains(library), 5.0))
    return sum((F.when(test, F.lit(w)).otherwise(0.0) for test, w in parts), F.lit(0.0))


def _token_weights(s: Column, library: Column | None) -> Column:
    return F.aggregate(F.transform(F.split(s, " ", -1), lambda t: word_weight(t, library)), F.lit(0.0), lambda a, x: a + x)


def line_weight(s: Column, library: Column) -> Column:
    """Weight of a line against a library's name; each token of a line with spaces adds a tenth to the factor."""
    n = F.size(F.split(s, " ", -1))
    return F.when(s.contains(" "), _token_weights(s, library) * (1 + n * 0.1)).otherwise(word_weight(s, library))


def string_weight(s: Column, full_token_factor: bool = False) -> Column:
    """Weight of an indexed string. Its factor with spaces is 1.1, whatever the number of tokens, unless
    ``full_token_factor`` asks for one that grows with them."""
    factor = 1 + F.size(F.split(s, " ", -1)) * 0.1 if full_token_factor else F.lit(1.1)
    return F.when(s.contains(" "), _token_weights(s, None) * factor).otherwise(word_weight(s))


def idf_score(weight: Column, total: Column, having: Column) -> Column:
    """weight * log10(total / having)."""
    return weight * F.log10(total / having)


def occurrence_score(count: Column, length: Column, score: Column, use_score: bool = True) -> Column:
    return count * (F.log2(length) + 1) / score if use_score else count


def unquoted(s: Column) -> Column:
    """A literal without its quotes: "x" and L"x" lose both, a leading quote alone goes too."""
    n = F.length(s)
    closed = s.endswith('"')
    return (
        F.when(s.startswith('"') & closed, F.substring(s, F.lit(2), F.greatest(n - 2, F.lit(0))))
        .when(s.startswith('L"') & closed, F.substring(s, F.lit(3), F.greatest(n - 3, F.lit(0))))
        .when(s.startswith('"'), F.substring(s, F.lit(2), n))
        .otherwise(s)
    )


def is_mangled(s: Column) -> Column:
    return s.startswith("?") | s.startswith(".?")


def last_segment(s: Column) -> Column:
    """A qualified name's last part."""
    return F.element_at(F.split(s, "::", -1), -1)


def binary_parameters(s: Column) -> Column:
    """Parameter types of an exported signature, normalised; see ``_types``."""

    def one(p: Column) -> Column:
        plain = F.array_join(F.array_sort(F.filter(F.split(p, " ", -1), lambda t: ~t.isin("class", "struct", "enum"))), " ")
        return F.when(p == "", F.lit("void")).when(p.isin("const char *", "char const *"), F.lit("const char *")).otherwise(plain)

    return F.transform(_types(s), one)


def source_parameters(s: Column) -> Column:
    """Parameter types of a declaration: the name of each parameter goes, a star on it stays."""

    def one(p: Column) -> Column:
        tokens = F.split(p, " ", -1)
        n = F.size(tokens)
        last = F.element_at(tokens, -1)
        kept = F.concat(F.slice(tokens, F.lit(1), n - 1), F.when(last.contains("*"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")), F.when(n == 1, F.array(F.trim(p))).otherwise(F.array().cast("array<string>")))
        text = p.contains("const char *") | p.contains("char const *")
        return F.when(p == "", F.lit("void")).when(text, F.lit("const char *")).otherwise(F.array_join(F.array_sort(kept), " "))

    return F.transform(_types(s), one)


def _types(s: Column) -> Column:
    """What stands between `(` and the first `)`, by commas."""
    opened, closed = F.locate("(", s), F.locate(")", s)
    return F.split(F.substring(s, opened + 1, F.greatest(closed - opened - 1, F.lit(0))), ",", -1)


def name_before_parameters(s: Column) -> Column:
    """Up to the first `(`; without one, all but the last character."""
    at = F.locate("(", s)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0))))
