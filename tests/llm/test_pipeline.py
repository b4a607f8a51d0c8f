"""The pipeline's stages in turn, and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from cases import awkward, empty
from tillrec.llm.decontaminate import words_of, windows_of

SF001 = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF001)
        assert out.columns[: len(columns)] == columns
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4] > 0
    bench = {w for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect() for w in windows_of(words_of(r["text"]), 10)}
    for r in docs.select("text").collect():
        w = words_of(r["text"])
        assert not any(tuple(w[i : i + 10]) in bench for i in range(len(w)))
    assert {r["shard"] for r in docs.select("shard").collect()} == set(range(8))


@pytest.mark.parametrize("table", [awkward, empty])
def test_stages_on_awkward_tables(spark, tmp_path, table):
    """Nulls, repeats, long and empty texts, clashing and dotted columns; and no rows at all."""
    docs = table(spark)
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF001)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        else:  # the last stage brings its own columns of these names
            assert {*columns} <= {*out.columns} and len({*out.columns}) == len(out.columns)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() <= 2 * n


def test_run_leaves_only_what_the_result_reads(spark):
    import os

    from tillrec.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(base) if f.startswith("pipeline-")}
    out = corpus_pipeline.run(spark, SF001)
    made = [f for f in os.listdir(base) if f.startswith("pipeline-") and f not in before]
    assert out.count() > 0 and len(made) == 1
    assert [f for f in os.listdir(f"{base}/{made[0]}") if not f.startswith(".")] == ["3-mix"]


@pytest.mark.parametrize("name", ["op2_nearest_by_codes", "op10_token_counts"])
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF001)
    assert df.count() > 0
