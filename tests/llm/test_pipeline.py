"""The pipeline's stages: columns, what each drops and keeps."""

import corpus_pipeline as C
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == columns
            m = out.count()
            assert m <= n and (m == n or name in ("toxicity", "minhash"))
            n = m
        docs = C.staged(out, "test")
    assert docs.count() == n and "ids" in docs.columns


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text, 1), (1, text, 2), (2, text + " more", 3), (9, "else entirely", 4), (None, text, 5), (4, None, 6)], "doc_id long, text string, n_chars long")
    assert sorted((r.n_chars for r in C.drop_near_duplicates(spark, docs, SF).collect())) == [2, 4, 5, 6]


def test_toxic_documents_go(spark, monkeypatch):
    import numpy as np

    model = C.toxicity.Model(np.zeros(C.toxicity.DIMS, np.float32))
    model.weights[C.toxicity.features(b"scum")] = 5.0
    monkeypatch.setattr(C.toxicity, "train", lambda *a, **k: model)
    docs = spark.createDataFrame([(1, "you scum"), (2, "you"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in C.drop_toxic(spark, docs, SF).collect()) == [2, 3]


@pytest.mark.parametrize("name", ["run"])
def test_run(spark, name):
    out = getattr(C, name)(spark, SF)
    assert out.count() > 0


def test_the_mixture_outlives_the_tables_between_stages(spark, tmp_path, monkeypatch):
    sizes = {"a": 4000, "b": 1000, "c": 250}
    rows = [(i, s, f"text {i} of {s}") for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(C, "STAGES", [x for x in C.STAGES if x[0] in ("mixing", "bpe")])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the sort writes several files
    try:
        got = [r.source for r in C.run(spark, f"file://{tmp_path}").select("source").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(rows)
    whole = C.mixing.whole_weights(C.mixing.tempered(sizes))
    for n in (80, 400, 1600):  # before the smallest source has run out, a block beside its share at most, and a begun block
        for s, w in whole.items():
            assert abs(got[:n].count(s) - n * w / C.mixing.SLOTS) < 2 * C.mixing.BLOCK


def test_every_stage_takes_odd_rows_and_none(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names, and an empty table."""
    from pyspark.sql import functions as F

    word = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(3000)]
    rows = [(1, " ".join(word[:200]), "s"), (2, None, "s"), (3, "", None), (None, "no id at all", "s"), (None, None, None), (4, " ".join(word[300:420]), "t"), (4, " ".join(word[300:420]), "t"), (5, "é " * 40_000, "u"), (6, "\n" * 30_000, "u")]
    clash = ["uid", "row", "rest", "spans", "sig", "n", "rep", "component", "score", "slot", "place", "block", "ids", "text_2"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in clash}).repartition(3)
    for table in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, table, SF)
            got = out.collect()
            if name == "bpe":
                assert sorted(r.doc_id or 0 for r in got) == sorted(r.doc_id or 0 for r in table.collect())
                continue
            assert out.columns == table.columns
            ids = sorted(r.doc_id or 0 for r in got)
            if table is docs:  # these are clean and no near-duplicates; rows that repeat a row stay by one rule
                assert ids == [0, 0, 1, 2, 3, 4, 4, 5, 6]
                texts = {r.doc_id: r.text for r in got}
                assert texts[1] == rows[0][1] and texts[5] is not None
                assert all(r[c] == c for r in got for c in clash)
            else:
                assert not got
