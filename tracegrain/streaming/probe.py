"""Scores for binaries as they arrive: a stream of strings against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def probe_stream(strings: DataFrame, index: DataFrame) -> DataFrame:
    """The index's postings of each arriving (bin_file, value); strings may come again, see ``append_scores``."""
    return strings.where(F.length("value").between(1, 65535)).join(index, "value")


def append_scores(strings: DataFrame, index: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write distinct hits of each micro-batch under its number; a batch that is run again replaces its own rows only."""

    def write(batch: DataFrame, number: int) -> None:
        hits = batch.select("bin_file", "value").distinct().where(F.length("value").between(1, 65535)).join(index, "value")
        hits.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = strings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def scores_so_far(hits: DataFrame) -> DataFrame:
    """bin_file, pj, dyn, ver, pj_score, ver_score, matched_count of all batches; a string counts once for each binary."""
    once = hits.select("bin_file", "value", "pj", "dyn", "ver", "pj_score", "ver_score").distinct()
    return once.groupBy("bin_file", "pj", "dyn", "ver").agg(F.sum("pj_score").alias("pj_score"), F.sum("ver_score").alias("ver_score"), F.count("*").alias("matched_count"))
