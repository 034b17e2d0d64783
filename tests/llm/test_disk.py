"""What operators leave on disk: in the shared folder and in Spark's own."""

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from vireo.llm import bpe, jaccard
from vireo.llm.common import passing, settled, shared_dir
from vireo.llm.lines import line_stage


def _tables(spark) -> set[Path]:
    at = Path(shared_dir(spark).removeprefix("file://")) / "vireo"
    return set(at.iterdir()) if at.exists() else set()


def _new(spark, before: set[Path]) -> list[str]:
    return sorted(p.name.rsplit("-", 1)[0] for p in _tables(spark) - before)


def _shuffled(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_pipeline_keeps_only_what_its_last_stage_reads(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some passage of ten words that nobody has in a text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = _tables(spark)
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert [n for n in _new(spark, before) if n.startswith("pipeline-")] == ["pipeline-decontamination"]
    assert not {"keyed", "sized", "slim", "members", "rows", "verdict", "lines", "gone"} & set(_new(spark, before))
    rows.collect()  # nothing that it reads is gone


def test_stages_remove_their_tables(spark, docs, sf):
    before = _tables(spark)
    assert jaccard.without_near_duplicates(docs).count() > 0
    assert set(_new(spark, before)) == {"verdict", "words"}
    before = _tables(spark)
    assert line_stage(spark, docs, sf).count() == docs.count()
    assert _new(spark, before) == ["gone"]


def test_passing_keeps_what_it_is_told(spark):
    with passing(spark):
        with passing(spark) as keep:
            a, b = keep(settled(spark.range(3), "a")), settled(spark.range(3), "b")
        there = {p.as_uri() for p in _tables(spark)}
        assert a.settled_at in there and b.settled_at not in there
    assert a.settled_at not in {p.as_uri() for p in _tables(spark)}


def test_settled_leaves_no_shuffle_files(spark):
    before = _shuffled(spark)
    settled(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count(), "counts")
    until = time.time() + 20
    while _shuffled(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert _shuffled(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_keys_in_parts_find_the_same(spark, docs, monkeypatch):
    whole = sorted(map(tuple, jaccard.jaccard_components(docs).collect()))
    monkeypatch.setattr(jaccard, "PARTED_BITS", 1)
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == whole


def test_few_slots_lose_no_row(spark, docs, odd, monkeypatch):
    """With 64 slots nearly every row is a false hit; the join decides."""
    for table in (docs, odd):
        whole = sorted(map(repr, jaccard.without_near_duplicates(table).collect()))
        with monkeypatch.context() as m:
            m.setattr(jaccard, "SLOTS", 64)
            assert sorted(map(repr, jaccard.without_near_duplicates(table).collect())) == whole


def test_fewer_rows_in_a_query_give_the_same_tokens(docs):
    files = bpe._files()
    docs = docs.union(docs).union(docs).coalesce(1)  # more than go to a query at a time
    whole = sorted(map(tuple, bpe.round_trip(docs, *files).collect()))
    assert sorted(map(tuple, bpe.round_trip(docs, *files, forget=True).collect())) == whole
    few = bpe.Codec(*files, 100, 7, 5)
    texts = ["some words of a text, 12345 of them", "", "日本語 🙂 odd", "x" * 300]
    found = few.encode(texts)
    assert found == bpe.Codec(*files).encode(texts)
    assert few.decode([np.frombuffer(x, "<u4") for x, _ in found]) == [t.encode() for t in texts]
