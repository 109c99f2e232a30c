"""Dependency graphs: closures by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, parent: str = "output", child: str = "dependency", most: int = 64) -> DataFrame:
    """All (``parent``, ``child``) pairs by a path. Path lengths double in each round, so a depth of d takes log2 d rounds;
    each round is cut from its lineage by a checkpoint where the session names a folder."""
    spark = edges.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    reach = edges.select(parent, child).where(F.col(parent) != F.col(child)).distinct()
    seen = -1
    for _ in range(most):
        if folder:
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(folder)
            reach = reach.checkpoint()
        n = reach.count()
        if n == seen:
            return reach
        seen = n
        left, right = reach.withColumnRenamed(child, "_mid"), reach.withColumnRenamed(parent, "_mid")
        reach = reach.union(left.join(right, "_mid").select(parent, child)).where(F.col(parent) != F.col(child)).distinct()
    return reach


def sources_of_outputs(commands: DataFrame) -> DataFrame:
    """output, sources: the source files that outputs flatten to; only outputs all of whose files are resolved.

    ``commands``: output, dependency (array), is_elf. Objects are resolved from the start; an output is when every
    dependency that has a command is. What has no command of its own gives nothing, unless it is an object's source.
    """
    edges = commands.select("output", F.explode("dependency").alias("dependency"))
    all_ = closure(edges)
    leaf = commands.where("NOT is_elf").select(F.col("output").alias("object"), F.explode("dependency").alias("file"))
    elf = commands.where("is_elf").select("output")
    own = all_.join(leaf.withColumnRenamed("object", "dependency"), "dependency").join(elf, "output", "left_semi")
    return own.groupBy("output").agg(F.array_sort(F.collect_set("file")).alias("sources"))


def inferred_objects(missing: DataFrame, files: DataFrame) -> DataFrame:
    """path, source: objects without a command and the source they come from, by the same path with a source's suffix
    (also without `/.libs`), else by a name that only one file below has."""
    stem = F.regexp_replace("path", r"\.l?o$", "")
    objects = missing.where(F.col("path").rlike(r"\.l?o$")).select("path", F.explode(F.array_distinct(F.array(stem, F.regexp_replace(stem, r"/\.libs/", "/")))).alias("stem"))
    sources = files.where(F.col("path").rlike(r"\.(c|cpp|cc|cxx)$")).select(F.col("path").alias("source"), F.regexp_replace("path", r"\.(c|cpp|cc|cxx)$", "").alias("stem"))
    exact = objects.join(sources, "stem").groupBy("path").agg(F.min("source").alias("source"))
    name = F.substring_index("stem", "/", -1)
    left = objects.join(exact, "path", "left_anti").select("path", name.alias("name")).distinct()
    near = left.join(sources.select("source", name.alias("name")), "name").where(F.col("source").startswith(F.regexp_replace("path", r"[^/]*$", "")))
    single = near.groupBy("path").agg(F.count("*").alias("n"), F.min("source").alias("source")).where("n = 1").select("path", "source")
    return exact.unionByName(single)


def needed_outputs(commands: DataFrame, resolved: DataFrame) -> DataFrame:
    """file, output, is_resolved: the outputs that were marked as needed; all binaries where a log marks none."""
    marked = commands.groupBy("file").agg(F.bool_or("needed").alias("any"))
    rows = commands.join(marked, "file").where(F.when(F.col("any"), F.col("needed")).otherwise(F.col("is_elf"))).select("file", "output").distinct()
    return rows.join(resolved.select("output", F.lit(True).alias("r")).distinct(), "output", "left").select("file", "output", F.coalesce("r", F.lit(False)).alias("is_resolved"))
