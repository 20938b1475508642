"""A pipeline that broke off goes on behind its last finished stage."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_broken_run_goes_on(spark, tmp_path, monkeypatch):
    calls = []

    def stage(name, fails=False):
        def take(spark, docs, sf_dir):
            calls.append(name)
            if fails:
                raise RuntimeError(name)
            return docs.where("doc_id % 7 <> 0") if name == "first" else docs.select("doc_id")

        return name, take

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("first"), stage("second", fails=True)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, f"{tmp_path}/run")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("first"), stage("second")])
    got = corpus_pipeline.run(spark, SF, f"{tmp_path}/run")
    assert got.columns == ["doc_id"] and got.count() == spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 7 <> 0").count()
    assert calls == ["first", "second", "second"]
