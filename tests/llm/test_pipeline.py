"""The pipeline's stages on a small table: columns, decisions, and equality with the operators."""

import corpus_pipeline as p
from depweave.llm import ngram_join


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, small).cache()
        assert after.columns == columns
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        assert all(r.n_chars == len(r.text) for r in after.collect())
        if name == "ngram_join":
            again = ngram_join.link_components(after, words=p.WORDS, percent=p.PERCENT)
            assert again.filter("component_id <> doc_id").count() == 0
        if name == "language_id":
            assert after.count() >= 0.98 * before.count()
        before = after
    packed = p.STAGES[-1][1](spark, before, small)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_run(spark, small):
    rows = p.run(spark, small)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_awkward_rows(spark, small):
    """Nulls, empty texts, repeated rows and clashing names in each stage; every stage takes an empty table."""
    base = " ".join(f"word{i} goes by the old river" for i in range(12))
    rows = [(1, base, "en", "x"), (2, base + " end", "en", "x"), (2, base + " end", "en", "x"), (3, None, None, None), (4, "", "en", "x"), (None, base, "en", "x"), (5, "short one", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, component_id string")
    near = p.drop_near_duplicates(spark, docs, small)
    assert near.columns == docs.columns and sorted((r.doc_id for r in near.collect()), key=str) == [1, 3, 4, 5, None]
    cut = p.drop_repeated_strings(spark, docs, small).collect()
    assert {r.doc_id for r in cut if r.doc_id in (3, 4, 5)} == {3, 4, 5} and next(r.text for r in cut if r.doc_id == 1) == base
    packed = p.pack(spark, docs, small)
    assert packed.filter("doc_id in (3, 4)").count() == 2 and packed.count() == len(rows)
    for name, stage in p.STAGES:
        assert stage(spark, docs.filter("false"), small).count() == 0, name


def test_language_stage_reads_small_batches(spark, small):
    """Whole rows pass through Python inside the stage, in small batches; what it returns holds no Python step."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = corpus_pipeline.identify_language(spark, docs, small)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and found.columns == docs.columns
    assert 0 < found.count() <= docs.count()


def test_language_stage_writes_no_table(spark, small):
    """Rows pass the language stage as they are read; a table of them would take disk until the pipeline ends."""
    from pathlib import Path

    from depweave.session import checkpoint_root

    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = Path(checkpoint_root(spark), "tables")
    before = set(tables.glob("*"))
    found = p.identify_language(spark, docs, small)
    assert found.count() > 0 and set(tables.glob("*")) == before
