"""Working tables, and entry points without the corpus operators."""

import builtins
import sys
import types

import pytest

import __spark_entry__
from chronoplace import shared


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        conf = types.SimpleNamespace(get=lambda key, default=None: folder, set=lambda key, value: None)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))

    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_folder(session(master))
        assert shared.shared_folder(session(master, "hdfs:///work/")) == "hdfs:///work"
    assert shared.shared_folder(session("local[4]")).startswith("file://")


def test_tables_are_written_read_and_dropped(spark):
    before = spark.conf.get(shared._CLEANUP, None)
    one = shared.materialise(spark.range(10).repartition(3), "t")
    two = shared.materialise(one.groupBy((one.id % 3).alias("k")).count(), "t")
    assert one.count() == 10 and two.count() == 3 and spark.conf.get(shared._CLEANUP, None) == before
    assert shared.exists(spark, one._chronoplace_path)
    shared.drop(one, two)
    assert not shared.exists(spark, one._chronoplace_path)
    with pytest.raises(Exception, match="boom"):
        shared.materialise(spark.sql("SELECT raise_error('boom') AS x"), "t")
    assert spark.conf.get(shared._CLEANUP, None) == before


def test_versions_follow_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    one = shared.version(spark.read.parquet(path))
    assert shared.version(spark.read.parquet(path)) == one
    spark.range(4).write.mode("append").parquet(path)
    assert shared.version(spark.read.parquet(path)) != one


@pytest.mark.parametrize("gone", ["chronoplace.llm", "tiktoken", "public_tokenizers", "corpus_pipeline"])
def test_entry_points_live_without_the_corpus_operators(monkeypatch, gone):
    for name in [m for m in sys.modules if m.startswith("chronoplace.llm") or m in ("corpus_pipeline", "tiktoken", "public_tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def missing(name, globals=None, locals=None, fromlist=(), level=0):
        asked = {name, *(f"{name}.{x}" for x in fromlist or ())}
        if any(a == gone or a.startswith(gone + ".") for a in asked):
            raise ImportError(f"no module named {gone}")
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", missing)
    names, sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert "hybrid_search" in names and sql <= names and "pipeline" not in names
    if gone != "corpus_pipeline":
        assert not any(n.startswith("op") and n[2].isdigit() for n in names)
