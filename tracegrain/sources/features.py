"""Feature tables of libraries and binaries: which are needed, how they load, what extraction keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encoding import whole_number

#: Suffixes of sources and of headers.
SOURCE_SUFFIXES, HEADER_SUFFIXES = ("c", "cpp", "cc", "cxx"), ("h", "hpp")
#: The tables that a family of comparison needs on either side.
SOURCE_TABLES = {
    "export": ("export", "func_name"), "string": ("string",), "string_array": ("string_array",), "const_enum_array": ("enum_array",),
    "const_num_array": ("num_array",), "switch_case": ("switch",), "if_else": ("if",),
}
BINARY_TABLES = {
    "export": ("export_func",), "string": ("hard_string", "export_func"), "string_array": ("hard_string",), "const_enum_array": ("bytes",),
    "const_num_array": ("bytes",), "switch_case": ("switch_case",), "if_else": ("nested_if",),
}


def needed_tables(families: list[str], side: str = "source") -> list[str]:
    """The tables of a side that the families need; others are not read."""
    table = SOURCE_TABLES if side == "source" else BINARY_TABLES
    return sorted({t for f in families for t in table[f]})


def chosen_libraries(libraries: DataFrame, names: list[str] | None = None, unique: bool = False) -> DataFrame:
    """Library rows by name, all if none is given; ``unique`` keeps the first version of each name."""
    rows = libraries if names is None else libraries.where(F.col("pj").isin(*names))
    if not unique:
        return rows
    first = Window.partitionBy("pj").orderBy("ver")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def analysed(projects: DataFrame) -> DataFrame:
    """pj, ver of the projects whose analysis is done."""
    return projects.where("analyse_status = 1").select("pj", "ver")


def features_of(dynamics: DataFrame, features: DataFrame) -> DataFrame:
    """lib, dyn and the features' columns: a component has the features of all its source files, as often as they are."""
    ids = dynamics.select("lib", "dyn", F.explode("src_source_ids").alias("src_source_id"))
    return ids.join(features, "src_source_id").drop("src_source_id")


def read_json_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested features that a disassembler's scripts left as JSON."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def literal_text(token: Column) -> Column:
    """The text of a string literal token of more than two characters; null for other tokens and for wide literals."""
    return F.when((F.length(token) > 2) & token.startswith('"') & token.endswith('"'), F.regexp_replace(token, '^"|"$', ""))


def defined_functions(declarations: DataFrame) -> DataFrame:
    """Definitions of functions and methods in the project's own files, operators left out. Columns: kind, name, is_definition,
    in_project, depth of enclosing classes."""
    return declarations.where(F.col("kind").isin("FUNCTION_DECL", "CXX_METHOD") & F.col("is_definition") & F.col("in_project") & ~F.col("name").startswith("operator") & (F.col("class_depth") <= 1))


#: The kinds of nodes an initialiser may have to be a list of numbers.
NUMBER_NODES = ("INTEGER_LITERAL", "UNARY_OPERATOR", "BINARY_OPERATOR", "COMPOUND_LITERAL_EXPR", "INIT_LIST_EXPR")


def is_number_list(kinds: Column) -> Column:
    return (F.size(kinds) > 0) & F.forall(kinds, lambda k: k.isin(*NUMBER_NODES))


def write_totals(totals: DataFrame, path: str) -> None:
    """Replace the totals of all components."""
    totals.write.mode("overwrite").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """The array index, a folder for each trie number, so that a search of one of them reads it alone."""
    index.write.mode("overwrite").partitionBy("trie_no").parquet(path)


def read_index(spark: SparkSession, path: str, trie_no: int = 0) -> DataFrame:
    """All parts, or one of 1 to 3."""
    rows = spark.read.parquet(path)
    return rows if trie_no == 0 else rows.where(F.col("trie_no") == trie_no)


def write_passed_by(rows: DataFrame, path: str) -> None:
    """Distinct (arr, pj, dyn, ver)."""
    rows.select("arr", "pj", "dyn", "ver").distinct().write.mode("overwrite").parquet(path)


def literal_array(text: Column) -> Column:
    """The whole numbers of an initialiser like `{1, 0x2, 3u}`, without those that are none."""
    inner = F.regexp_replace(text, r"^\s*\{|\}\s*$", "")
    values = F.transform(F.filter(F.split(inner, ",", -1), lambda t: F.trim(t) != ""), lambda t: whole_number(F.trim(t)))
    return F.filter(values, lambda v: v.isNotNull())


def first_items(arrays: Column) -> Column:
    """The first element of each item."""
    return F.transform(arrays, lambda x: F.try_element_at(x, F.lit(1)))


def files_to_analyse(wanted: DataFrame, tree: DataFrame) -> DataFrame:
    """project, dyn, path: the files that a build named; a project it names none for has all its sources, and one without
    sources all its headers, as one component `fake_dynamic`. ``wanted``: project, dyn, path; ``tree``: project, path."""
    kind = F.when(F.lower("path").rlike(rf"\.({'|'.join(SOURCE_SUFFIXES)})$"), 1).when(F.lower("path").rlike(rf"\.({'|'.join(HEADER_SUFFIXES)})$"), 2)
    rest = tree.select("project", "path", kind.alias("kind")).where("kind IS NOT NULL").join(wanted.select("project").distinct(), "project", "left_anti")
    best = rest.groupBy("project").agg(F.min("kind").alias("kind"))
    fallback = rest.join(best, ["project", "kind"]).select("project", F.lit("fake_dynamic").alias("dyn"), "path")
    return wanted.select("project", "dyn", "path").unionByName(fallback)
