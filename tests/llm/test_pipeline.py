import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from packloom.llm.common import shuffles_end, stage_table, staged_tables
from packloom.llm.decontamination import leaks
from packloom.llm.jaccard_join import jaccard_join
from packloom.llm.pii import pii_spans
from packloom.llm.quality import good_quality, quality_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_take_effect(spark, sf):
    """Every stage against what its operator says of the same documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in C.STAGES[:-1]:
        after = C.stage_table(stage(spark, docs, sf), name)
        assert after.columns == COLUMNS
        had = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            good = {r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
            want = [r for d, r in had.items() if d in good]
        elif name == "near_copies":
            first = {r.doc_id for r in jaccard_join(docs, 5, (8, 10)).collect() if r.component_id == r.doc_id}
            want = [r for d, r in had.items() if d in first]
        elif name == "decontamination":
            bad = {r.doc_id for r in leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            want = [r for d, r in had.items() if d not in bad]
        else:
            spans = {r.c0: r.spans for r in pii_spans(docs, ["doc_id"]).collect()}
            want = []
            for d, r in had.items():
                text, end = "", 0
                for s in sorted(spans[d], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= end:
                        text += r.text[end : s["start"]] + "<" + ("EMAIL", "IP", "CARD", "PHONE")[s["kind"]] + ">"
                    end = max(end, s["end"])
                text += r.text[end:]
                want.append((d, text, r.lang, r.source, len(text)))
        assert rows_of(after) == sorted(map(tuple, want), key=repr)
        docs = after
    assert 0 < docs.count() < before
    packed = C.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    assert [n for n, _ in C.STAGES] == ["quality", "near_copies", "decontamination", "pii", "packing"] and C.ORACLE_SQL is None


def test_run_is_the_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = C.stage_table(stage(spark, docs, sf), "x")
    want = rows_of(C.STAGES[-1][1](spark, docs, sf).select("doc_id", "piece", "start", "length", "ids_crc32"))
    assert rows_of(C.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32")) == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with every kind of odd row, under names the stages use themselves."""
    at = str(tmp_path_factory.mktemp("odd"))
    good = "The committee met on Tuesday, and its members agreed on a plan for the new school near the river. "
    rows = [(k, good + f"Paragraph {k} says something else again, number {k * k}, in its own words. " * 3, "en", "web", 0) for k in range(60)]
    rows += [(100, None, "en", None, None), (101, "", None, "web", 0), (None, good * 2, "en", "web", 1), (None, None, None, None, None)]
    rows += [(102, good * 2, "en", "web", 1), (102, good * 2, "en", "web", 1), (103, good + "mail me@a.org now", "en", "web", 1), (104, "word " * 60_000, "en", "long", 1), (105, "x" * 300_000, "en", "long", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumn("fp", F.lit(1)).withColumn("label", F.lit("x")).withColumn("gone", F.lit(2)).withColumn("spans", F.lit("s")).withColumn("c0", F.lit(0.5)).withColumn("id", F.lit("i"))
    df.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 7 > 0), 0) for k in range(60)] + [(None, 1, 0), (100, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "What is the name of the tallest building in that town? It is called the old tower."), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_odd_rows_in_every_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    first = rows_of(docs)
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, odd)
        assert got.columns == docs.columns and got.schema == docs.schema
        rows = rows_of(got)
        if name in ("quality", "decontamination"):
            assert set(rows) <= set(first) and (name == "quality" or rows == first)
            assert rows.count(next(r for r in first if r[0] == 102)) in (0, 2)
        elif name == "near_copies":
            assert sum(r[0] == 102 for r in rows) <= 1 and sum(r[1] is None or r[1] == "" for r in rows) == 3
            assert sum(r[0] is None for r in rows) == 2
        else:
            assert len(rows) == len(first) and all(r[4] == (None if r[1] is None else len(r[1])) for r in rows)
            assert next(r[1] for r in rows if r[0] == 103).endswith("mail <EMAIL> now")
    packed = C.STAGES[-1][1](spark, docs, odd)
    assert packed.groupBy("doc_id").count().count() == len({r[0] for r in first})


def test_empty_tables(spark, odd):
    none = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, odd).count() == 0


def test_quality_leaves_no_table(spark, sf):
    """A table with the texts would lie on the disk through the stages after it."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    before = staged_tables()
    kept = good_quality(docs, labels)
    assert staged_tables() == before
    good = {r.doc_id for r in quality_scores(docs, labels).collect() if r.predicted}
    assert rows_of(kept) == rows_of(docs.where(F.col("doc_id").isin(good)))


def test_shuffles_end_with_their_table(spark):
    """Not when the driver collects garbage: what made the table is still held here."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x for d in dirs for _, _, names in os.walk(d) for x in names if x.startswith("shuffle_")}
    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    made = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = stage_table(made, "counts")
    assert not files() - before
    assert rows_of(table) == rows_of(made) and spark.conf.get(setting, None) == was
    with pytest.raises(ZeroDivisionError), shuffles_end(spark):
        1 / 0
    assert spark.conf.get(setting, None) == was
