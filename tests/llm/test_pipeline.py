"""The pipeline's stages beside what they are meant to do, each on its own input."""

import os

import corpus_pipeline
from pyspark.sql import functions as F

from tests.compare import duck
from tests.conftest import DATA
from tests.llm.test_near_copies import slow_kept
from tests.llm.test_operators import slow_contaminated, slow_file


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, DATA).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    gone = ids(inputs["toxicity"]) - ids(inputs["simhash_near_dedup"])
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert gone and not gone & clean

    before = [(r.doc_id, r.text) for r in inputs["simhash_near_dedup"].collect()]
    want, near = slow_kept(before)
    assert near and ids(inputs["decontamination"]) == want

    bench = [tuple(r) for r in duck(DATA).sql("SELECT item_id, text FROM benchmark").fetchall()]
    held = {(r.doc_id, r.text) for r in inputs["decontamination"].collect()} - {(r.doc_id, r.text) for r in inputs["mixing"].collect()}
    assert held and {d for d, _ in slow_contaminated(sorted(held), bench)} == {d for d, _ in held}
    kept = [(r.doc_id, r.text) for r in inputs["mixing"].orderBy("doc_id").limit(25).collect()]
    assert not slow_contaminated(kept, bench)

    assert ids(inputs["token_files"]) == ids(inputs["mixing"])
    rows = [(r.doc_id, r.text) for r in inputs["token_files"].collect()]
    got = sorted(map(tuple, docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == slow_file(rows)


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.where(F.col("n_tokens") < 1).count() == 0


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the stages' own."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "plain words of a short text", "en", "s", 27)]
    rows += [(3, "plain words of a short text", "en", "s", 27), (4, " ".join(f"w{i % 977}x{i % 13}" for i in range(60000)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, ddl)
    for name in ("rate", "row", "tokens", "node", "text_hash", "_gone", "_hash", "y", "part"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        kept = {(r.doc_id, len(r.text or "")) for r in out.collect()}
        assert (3, 27) in kept and any(i == 4 for i, _ in kept), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == docs.count()
    empty = docs.limit(0)
    assert [stage(spark, empty, "/root/testdata/sf0.001").count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_run_leaves_only_what_is_asked_for(spark):
    from tideline.llm.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    left = sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before)
    assert left == ["pipeline-token_files", "tokens"]
