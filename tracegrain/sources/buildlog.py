"""Build logs as tables: lines, commands, tokens, working directories, outputs and what they depend on.

A log is ordered, so windows run within one file; everything else is row-wise and stays in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Compilers, and flags that go with what follows them.
COMPILERS = ("cc", "gcc", "g++", "c++")
WITH_ARGUMENT = ("-rpath", "-version-info", "-export-symbols", "-MF", "-MT", "-version-number")
DROPPED = ("-I", "-l", "-L", "-O", "-f", "-g", "-p", "-std")
#: Language standards by their synonyms.
STANDARDS = {
    "c99": ("c99", "c9x", "iso9899:1999", "iso9899:199x"), "c11": ("c11", "c1x", "iso9899:2011"), "gnu99": ("gnu99", "gnu9x"), "gnu11": ("gnu11", "gnu1x"),
    "c++11": ("c++11", "c++0x"), "gnu++11": ("gnu++11", "gnu++0x"), "c++14": ("c++14", "c++1y"), "gnu++14": ("gnu++14", "gnu++1y"),
    "c++17": ("c++17", "c++1z"), "gnu++17": ("gnu++17", "gnu++1z"),
}
#: Names of files that stand in a source root, in lower case.
ROOT_FILES = ("install", "readme", "readme.md", "makefile", "configure", "config", "copying", "cmakelist.txt", "changelog")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line: tabs as four spaces."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.replace("value", F.lit("\t"), F.lit("    ")).alias("text"))
    return whole.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def joined_lines(lines: DataFrame) -> DataFrame:
    """file, line_no (of the first), line: a line that ends in a backslash goes on in the next; their backslashes are blanks."""
    w = Window.partitionBy("file").orderBy("line_no")
    goes_on = F.rtrim("line").endswith("\\")
    rows = lines.withColumn("on", goes_on).withColumn("new", F.when(F.coalesce(F.lag("on").over(w), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("new").over(w))
    whole = rows.groupBy("file", "part").agg(F.min("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["line"]), " ")
    return whole.select("file", "line_no", F.when(F.size("all") > 1, F.replace(text, F.lit("\\"), F.lit(" "))).otherwise(text).alias("line"))


def split_commands(line: Column) -> Column:
    """The commands of a line: one span in backticks goes, then `&&`, `;` and `|` part them, redirections are cut off."""
    entering = line.contains("Entering directory")
    spanned = F.regexp_replace(line, "^([^`]*)`[^`]*`", "$1")
    single = F.regexp_replace(line, "^([^`]*)`", "$1")
    clean = F.when(entering | ~line.contains("`"), line).when(line.rlike("`[^`]*`"), spanned).otherwise(single)
    parts = F.filter(F.split(clean, r"&&|;|\|", -1), lambda c: c != "")
    return F.transform(parts, lambda c: F.substring_index(F.substring_index(c, "1>&2", 1), " >", 1))


def tokens(command: Column) -> Column:
    """Words of a command; quotes keep what they enclose together. A shell keyword in front goes."""
    words = F.filter(F.regexp_extract_all(command, F.lit(r'((?:\\"[^"]*\\"|"[^"]*"|[^ ])+)'), 1), lambda t: t != "")
    shell = F.arrays_overlap(_path_words(F.try_element_at(words, F.lit(1))), F.array(F.lit("bash"), F.lit("if"), F.lit("then")))
    return F.when(F.coalesce(shell, F.lit(False)), F.slice(words, 2, 1_000_000)).otherwise(words)


def _path_words(token: Column) -> Column:
    return F.split(token, r"[/\\]", -1)


def _is(token: Column, names) -> Column:
    return F.coalesce(F.arrays_overlap(_path_words(token), F.array(*map(F.lit, names))), F.lit(False))


def command_kind(words: Column) -> Column:
    """cc, ar, cd, libtool, entering or ld; null for other commands."""
    first = F.try_element_at(words, F.lit(1))
    return (
        F.when(_is(first, COMPILERS), "cc").when(_is(first, ["ar"]), "ar").when(first == "cd", "cd").when(_is(first, ["libtool"]), "libtool")
        .when(first.startswith("make") & F.array_join(words, " ").contains("Entering directory"), "entering").when(first == "ld", "ld")
    )


def _fold(words: Column, kind: str, step) -> Column:
    """A pass over words with a flag for the one before: step(flag, word) gives (next flag, what to append or null)."""
    start = F.struct(F.lit(False).alias("flag"), F.array().cast(f"array<{kind}>").alias("out"))

    def merge(state, word):
        flag, item = step(state["flag"], word)
        return F.struct(flag.alias("flag"), F.when(item.isNull(), state["out"]).otherwise(F.array_append(state["out"], item)).alias("out"))

    return F.aggregate(words, start, merge, lambda state: state["out"])


def useful_tokens(words: Column) -> Column:
    """Words of a compiler's command without search paths, libraries, optimisation, warnings and definitions (but
    -DLT_OBJDIR=), and without some flags and their arguments."""
    plain = lambda w: F.replace(F.replace(w, F.lit('\\"'), F.lit("")), F.lit('"'), F.lit(""))

    def step(skip, word):
        drop = F.lit(False)
        for p in DROPPED:
            drop = drop | word.startswith(p)
        drop = drop | (word.startswith("-W") & ~word.startswith("-Wl")) | (word.startswith("-D") & ~word.startswith("-DLT_OBJDIR="))
        argument = word.isin(*WITH_ARGUMENT)
        return F.when(skip, F.lit(False)).otherwise(~drop & argument), F.when(~skip & ~drop & ~argument, word)

    return _fold(F.transform(words, plain), "string", step)


def compile_options(words: Column) -> Column:
    """-D, -L and -I options (a bare -I with the word after it), and -std by its canonical name."""
    named = {s: k for k, names in STANDARDS.items() for s in names}
    table = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))

    def step(pending, word):
        standard = F.when(word.startswith("-std"), F.coalesce(F.concat(F.lit("-std="), F.try_element_at(table, F.substring(word, 6, 1000))), word))
        item = F.when(pending, F.concat(F.lit("-I"), word)).when(word == "-I", F.lit(None)).when(word.rlike("^-[DLI]"), word).otherwise(standard)
        return ~pending & (word == "-I"), item

    return _fold(words, "string", step)


def normalized_path(path: Column) -> Column:
    """An absolute path without `.`, `..` and double slashes; `/.libs/.libs` is one."""
    parts = F.aggregate(
        F.split(path, "/", -1), F.array().cast("array<string>"),
        lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)),
    )
    return F.replace(F.concat(F.lit("/"), F.array_join(parts, "/")), F.lit("/.libs/.libs"), F.lit("/.libs"))


def absolute_path(path: Column, cwd: Column, libtool: bool = False) -> Column:
    whole = normalized_path(F.when(path.startswith("/"), path).otherwise(F.concat(cwd, F.lit("/"), path)))
    return F.regexp_replace(whole, r"\.l([ao])$", ".$1") if libtool else whole


def commands(lines: DataFrame) -> DataFrame:
    """file, line_no, part, words, kind: what is a command, in order. Bracketed and scanning lines are none."""
    rows = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"^(\[|Scanning|Dependee)"))
    bare = F.when(F.col("line").rlike(r"^\(.*\)$"), F.expr("substring(line, 2, length(line) - 2)")).otherwise(F.col("line"))
    rows = rows.select("file", "line_no", F.posexplode(split_commands(bare)).alias("part", "command"))
    rows = rows.where(~F.col("command").contains("`") | F.col("command").contains("Entering directory")).select("file", "line_no", "part", tokens(F.col("command")).alias("words"))
    return rows.where(F.size("words") > 0).withColumn("kind", command_kind(F.col("words")))


def with_cwd(cmds: DataFrame, start: Column | None = None) -> DataFrame:
    """Commands with cwd, the directory each runs in: the last entered one, and the `cd`s since.

    Paths are put together at commands that change the directory only, and carried on to the others.
    """
    w = Window.partitionBy("file").orderBy("line_no", "part")
    begin = start if start is not None else F.lit("/")
    entered = F.regexp_replace(F.try_element_at("words", F.lit(4)), "^.(.*).$", "$1")
    target = F.when(F.col("kind") == "entering", entered).when(F.col("kind") == "cd", F.try_element_at("words", F.lit(2)))
    rows = cmds.withColumn("_to", target).withColumn("_abs", F.coalesce(F.col("_to").startswith("/") | (F.col("kind") == "entering"), F.lit(False)))
    rows = rows.withColumn("_since", F.sum(F.col("_abs").cast("int")).over(w))
    within = Window.partitionBy("file", "_since").orderBy("line_no", "part").rowsBetween(Window.unboundedPreceding, 0)
    after = F.array_join(F.collect_list("_to").over(within), "/")
    base = F.when(F.col("_since") == 0, F.concat(begin, F.lit("/"), after)).otherwise(after)
    moving = rows.where("_to IS NOT NULL").withColumn("_in", normalized_path(base))
    rest = rows.where("_to IS NULL").withColumn("_in", F.lit(None).cast("string"))
    # a command that enters a directory itself still runs in the one before
    before = F.last("_in", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return moving.unionByName(rest).withColumn("cwd", F.coalesce(before, normalized_path(begin))).drop("_to", "_abs", "_since", "_in")


def is_source(path: Column) -> Column:
    return path.rlike(r"\.(c|cpp|cc|cxx)$")


def parsed_commands(cmds: DataFrame) -> DataFrame:
    """file, output, dependency, is_elf, needed of compiler, libtool, ar and ld commands (with cwd).

    A compiler's output is an object if it has one source only and no linker flags; without `-o` it is the first input's name with
    .o. Archives, linkers and libraries with a soname are needed outputs. Commands without inputs give nothing.
    """
    at = F.array_position(F.transform("words", lambda t: _is(t, COMPILERS)), True)
    inner = F.when(F.col("kind") == "libtool", F.when((at > 0) & F.exists("words", lambda t: t.isin("--mode=compile", "--mode=link")), F.slice("words", at.cast("int"), 1_000_000))).when(F.col("kind") == "cc", F.col("words"))
    link = (F.col("kind") == "libtool") & F.array_contains("words", "--mode=link")
    cc = cmds.where(F.col("kind").isin("cc", "libtool")).select("file", "line_no", "part", "cwd", link.alias("link"), inner.alias("words")).where("words IS NOT NULL")
    # a directory after a bare -I or -L is no input
    files = _fold(F.col("words"), "string", lambda skip, t: (~skip & t.isin("-I", "-L"), F.when(~skip & ~t.isin("-I", "-L"), t)))
    cc = cc.withColumn("w", F.slice(useful_tokens(files), 2, 1_000_000))
    inputs = _fold(F.col("w"), "string", lambda skip, t: (~skip & (t == "-o"), F.when(~skip & ~t.startswith("-") & ~t.rlike(r"\.(s|asm)$"), t)))
    outputs = _fold(F.col("w"), "string", lambda take, t: (~take & (t == "-o"), F.when(take, t)))
    cc = cc.select("file", "line_no", "part", "cwd", "link", "w", F.transform(inputs, lambda t: absolute_path(t, F.col("cwd"), True)).alias("dependency"), F.try_element_at(outputs, F.lit(-1)).alias("o")).where(F.size("dependency") > 0)
    wl = F.exists("w", lambda t: t.startswith("-Wl"))
    first = F.element_at("dependency", 1)
    output = F.when(F.col("o").isNotNull(), absolute_path(F.col("o"), F.col("cwd"), True)).otherwise(absolute_path(F.concat(F.substring_index(F.substring_index(first, "/", -1), ".", 1), F.lit(".o")), F.col("cwd")))
    single = is_source(first) & (F.size("dependency") == 1)
    cc = cc.withColumn("output", output).select(
        "file", "line_no", "part", "output", "dependency", (F.when(wl, F.lit(True)).otherwise(~single)).alias("is_elf"),
        (F.exists("w", lambda t: t.startswith("-Wl") & t.contains("-soname")) | (F.col("link") & F.col("output").endswith(".a"))).alias("needed"),
    )
    paths = lambda words: F.transform(words, lambda t: absolute_path(t, F.col("cwd")))
    ar = cmds.where((F.col("kind") == "ar") & (F.size("words") > 2) & ~F.element_at("words", 2).contains("x"))
    ar = ar.select("file", "line_no", "part", absolute_path(F.element_at("words", 3), F.col("cwd")).alias("output"), F.array_distinct(paths(F.slice("words", 4, 1_000_000))).alias("dependency"), F.lit(True).alias("is_elf"), F.lit(True).alias("needed"))
    rest = F.slice("words", 2, 1_000_000)
    ld_in = _fold(rest, "string", lambda skip, t: (~skip & t.isin("-o", "-T"), F.when(~skip & ~t.startswith("-"), t)))
    ld_out = _fold(rest, "string", lambda take, t: (~take & (t == "-o"), F.when(take, t)))
    ld = cmds.where("kind = 'ld'").select("file", "line_no", "part", absolute_path(F.try_element_at(ld_out, F.lit(-1)), F.col("cwd")).alias("output"), paths(ld_in).alias("dependency"), F.lit(True).alias("is_elf"), F.lit(True).alias("needed"))
    return cc.unionByName(ar).unionByName(ld)


def latest(parsed: DataFrame) -> DataFrame:
    """One row for each output of a file: the last command's; `needed` if any was. Archives gather all their members."""
    key = F.struct("line_no", "part")
    archive = F.col("output").endswith(".a")
    rows = parsed.groupBy("file", "output").agg(
        F.max_by("dependency", key).alias("last"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "part", "dependency"))), lambda x: x["dependency"]))).alias("every"),
        F.max_by("is_elf", key).alias("is_elf"), F.bool_or("needed").alias("needed"),
    )
    return rows.select("file", "output", F.when(archive, F.col("every")).otherwise(F.col("last")).alias("dependency"), "is_elf", "needed")


def unique_basenames(files: DataFrame) -> DataFrame:
    """name, path of the files whose name occurs once below the root."""
    name = F.substring_index("path", "/", -1)
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("name", "path")


def options_by_source(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """source, key, options: the options of the last line that names a source, as a word, and has any; where the path is in
    none, of the last that has its basename, under `-name`.

    Lines meet sources by basename, an equi-join on the words of the line; the whole path decides as a residual.
    """
    parts = F.array_distinct(F.filter(F.split("line", r"[^A-Za-z0-9_.+*-]+", -1), lambda t: t.contains(".")))
    told = lines.select("line_no", "line", compile_options(F.split("line", " ", -1)).alias("options")).where(F.size("options") > 0)
    words = told.withColumn("name", F.explode(parts))
    hits = sources.select("source", F.substring_index("source", "/", -1).alias("name")).join(words, "name")
    quoted = F.concat(F.lit(r"(^|[^A-Za-z0-9_])\Q"), F.col("source"), F.lit(r"\E($|[^A-Za-z0-9_])"))
    hits = hits.withColumn("whole", F.rlike(F.col("line"), quoted))
    best = hits.groupBy("source", "name").agg(F.max_by("options", F.struct("whole", "line_no")).alias("options"), F.max("whole").alias("whole"))
    return best.select("source", F.when(F.col("whole"), F.col("source")).otherwise(F.concat(F.lit("-"), "name")).alias("key"), "options")


def root_scores(files: DataFrame) -> DataFrame:
    """dir, score: how many files of a source root's kind a directory has."""
    return files.groupBy("dir").agg(F.count_if(F.lower("name").isin(*ROOT_FILES)).alias("score"))


def symbol_table(lines: DataFrame) -> DataFrame:
    """file, name: last words of the global symbols below a table's header, hidden ones left out."""
    w = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("in_table", F.max(F.col("line").contains("SYMBOL TABLE:").cast("int")).over(w) == 1)
    words = F.split("line", " ", -1)
    rows = rows.where(F.col("in_table") & ~F.col("line").contains(".hidden") & (F.size(words) > 2))
    return rows.where(F.element_at(words, 2) == "g").select("file", F.element_at(words, -1).alias("name"))
