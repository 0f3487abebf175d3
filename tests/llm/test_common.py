"""The shared folder: that of the session, one of our own on one machine, none of our own on a cluster."""

from types import SimpleNamespace

import pytest

from foliospark.llm import common


def session(master, named=None):
    said = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: said[-1] if said else None, setCheckpointDir=said.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]", "local[4, 2]"])
def test_one_machine(master):
    spark = session(master)
    assert common.shared_dir(spark).startswith("file:///") and common.shared_dir(spark) == common.shared_dir(spark)


@pytest.mark.parametrize("master", ["local-cluster[3,2,3000]", "yarn", "spark://a:7077", "k8s://https://a"])
def test_cluster(master):
    assert common.shared_dir(session(master, "hdfs://a/b/")) == "hdfs://a/b"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session(master))
