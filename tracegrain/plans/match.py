"""One call over all families: a row for each pair of a component and a binary that a family has evidence on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import strings as S
from ..operators import switches as W
from ..operators import symbols as Y
from ..staging import staged

FAMILIES = ("export", "func_name", "string", "string_array", "const_enum_array", "const_num_array", "switch_case", "if_else")
_COLUMNS = ("bin_file", "library", "dyn", "feature", "matched", "similarity", "score")
_SEPARATOR = "\u0001"


def match(libraries: dict[str, DataFrame], binaries: dict[str, DataFrame], features=FAMILIES, use_score: bool = True, byte_aligned: bool = False, wide: bool = False) -> DataFrame:
    """bin_file, library, dyn, feature, matched, similarity, score.

    ``libraries`` and ``binaries`` hold the feature tables by name; a family whose table is missing on either side is
    skipped, and its tables are not read. A pair without any common evidence has no row, like one that was
    never compared.
    """
    out: list[DataFrame] = []
    key = F.concat_ws(_SEPARATOR, "lib", "dyn")

    def has(side: dict, *names: str) -> bool:
        return all(n in side for n in names)

    def take(rows: DataFrame, feature: str, similarity, score, joined: str | None = None) -> None:
        if joined:
            parts = F.split(joined, _SEPARATOR)
            rows = rows.withColumns({"library": parts[0], "dyn": parts[1]})
        rows = rows.withColumns({"feature": F.lit(feature), "similarity": similarity.cast("double"), "score": score.cast("double")})
        out.append(rows.select(*_COLUMNS))

    if "export" in features and has(libraries, "export") and has(binaries, "export"):
        rows = Y.match_exports(libraries["export"].select(key.alias("lib"), "name"), binaries["export"])
        take(rows, "export", F.col("similarity"), F.col("score"), "lib")
    if "func_name" in features and has(libraries, "func_name") and has(binaries, "export"):
        exports = libraries["export"].select(key.alias("lib"), "name") if has(libraries, "export") else None
        rows = Y.match_function_names(libraries["func_name"].select(key.alias("lib"), "name"), binaries["export"], exports)
        take(rows, "func_name", F.col("similarity"), F.col("score"), "lib")
    if "string" in features and has(libraries, "string") and has(binaries, "string"):
        rows = S.match_pairwise(libraries["string"].withColumnRenamed("lib", "pj"), binaries["string"], use_score).withColumnRenamed("pj", "library")
        take(rows, "string", F.col("percent"), F.col("weights"))
    if "string_array" in features and has(libraries, "string_array") and has(binaries, "string"):
        rows = S.match_string_arrays(libraries["string_array"].withColumnRenamed("lib", "pj"), binaries["string"]).withColumnRenamed("pj", "library")
        take(rows, "string_array", F.col("array_percent"), F.col("matched_strings"))
    for feature, table in (("const_enum_array", "enum_array"), ("const_num_array", "num_array")):
        if feature in features and has(libraries, table) and has(binaries, "bytes"):
            arrays = libraries[table].withColumn("lib", key)
            needles = staged(A.needle_table(A.distinct_arrays(arrays, "lib", "seq"), "lib", wide), "needles")
            needles = staged(A.without_subsumed(needles, "lib"), "needles")
            rows = A.match_arrays(needles, binaries["bytes"], "lib", byte_aligned, use_score)
            take(rows, feature, F.col("similarity"), F.col("success"), "lib")
    if "switch_case" in features and has(libraries, "switch") and has(binaries, "switch"):
        rows = W.match_switches(libraries["switch"].withColumn("lib", key), binaries["switch"])
        take(rows, "switch_case", F.col("count"), F.col("count"), "lib")
    if "if_else" in features and has(libraries, "if") and has(binaries, "if"):
        rows = W.match_chains(libraries["if"].withColumn("lib", key), binaries["if"])
        take(rows, "if_else", F.col("similarity"), F.lit(None), "lib")
    if not out:
        raise ValueError("no family has tables on both sides")
    return reduce(DataFrame.unionByName, out)
