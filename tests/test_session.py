from types import SimpleNamespace

import pytest

from marlstone import session


def named(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert session.shared_folder(named("local[4]")) == session.shared_folder(named("local")) == session.LOCAL_SCRATCH
    assert session.shared_folder(named("yarn", "hdfs://x/scratch/")) == "hdfs://x/scratch"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(named(master))


def test_spread(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = session.spread(docs.select("doc_id", "text"))
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and wide.count() == docs.count()
    plan = session.spread(docs).where("doc_id > 3").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,3)]" in plan and "ReadSchema: struct<doc_id:bigint>" in plan
    assert session.spread(spark.range(3)).rdd.getNumPartitions() == spark.range(3).rdd.getNumPartitions()
    monkeypatch.setattr(session, "SPREAD_BYTES", 10)
    assert session.spread(docs) is docs


def test_cut_and_remove(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    df = session.cut(spark.range(5), "t")
    assert df.count() == 5 and str(tmp_path) in df.inputFiles()[0]
    session.remove(spark, f"file://{tmp_path}/shared")
    assert not (tmp_path / "shared").exists()
