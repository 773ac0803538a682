"""Shared storage: a cluster without a shared folder is an error."""

import types

import pytest

from lexiframe import session


class _Conf:
    def get(self, key, default=None):
        return default


def _session(master):
    made = []
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    return types.SimpleNamespace(conf=_Conf(), sparkContext=context), made


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_cluster_needs_a_shared_folder(master):
    spark, made = _session(master)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(spark)
    assert not made


def test_local_master_gets_a_folder():
    spark, made = _session("local[2]")
    assert session.checkpoint_dir(spark) == made[0]


def test_scratch_folders_can_be_cleared(spark):
    df = session.cut_lineage(spark.range(3), "gone")
    assert df.count() == 3
    assert session.clear_scratch(spark) is True and session.clear_scratch(spark) is False
    assert session.cut_lineage(spark.range(4), "next").count() == 4
