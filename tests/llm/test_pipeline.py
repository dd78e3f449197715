import corpus_pipeline
import __spark_entry__


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = set(r.doc_id for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir))
        now = [r.doc_id for r in docs.collect()]
        assert set(now) <= seen
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in ("language_id", "quality", "near_dedup"):
            assert len(now) == len(set(now))
            assert 0.5 * len(seen) < len(now)
        seen = set(now)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_odd_documents(spark, odd, none, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            got = stage(spark, docs, sf_dir)
            rows = got.select("doc_id").collect()
            assert {r.doc_id for r in rows} <= {r.doc_id for r in odd.select("doc_id").collect()}
            assert (not rows) if docs is none else len(rows) == docs.count() if name == "bpe" else bool(rows)
            if name != "bpe":
                assert got.columns == docs.columns


def test_registered():
    names = list(__spark_entry__.queries())
    assert [f"op{n}" for n in range(1, 14)] == [x.split("_")[0] for x in names if x[:2] == "op" and x[2].isdigit()]
    assert "pipeline" in names


def test_stages_leave_no_scratch_tables(spark, sf_dir, monkeypatch):
    """Once a stage's rows are written, neither the rows before it nor its other tables are needed."""
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(corpus_pipeline.written(docs.where("doc_id % 2 = 0")))
        return seen[-1].select("doc_id", "text")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", lambda spark, docs, sf_dir: docs)])
    with corpus_pipeline.tables_written() as tables:
        rows = corpus_pipeline.run(spark, sf_dir).count()
    there = [t for t in tables if (p := spark._jvm.org.apache.hadoop.fs.Path(t._scratch)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    assert rows and len(tables) == 4 and [t._scratch for t in there] == [tables[-1]._scratch]
