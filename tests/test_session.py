"""Checkpoint-folder rules: read the configured shared folder; never invent a local one on a cluster."""

import pytest

from vocabshift.session import CLUSTER_CONF, checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, configured=None):
        self.master = master
        self._conf = _Conf({"spark.checkpoint.dir": configured} if configured else {})
        self._dir = None

    def getCheckpointDir(self):
        return self._dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self._dir = path


class _Session:
    def __init__(self, context):
        self.sparkContext = context


def test_configured_folder_is_used_as_is():
    ctx = _Context("spark://cluster:7077", configured="hdfs://shared/ckpt")
    assert checkpoint_dir(_Session(ctx)) == "hdfs://shared/ckpt"


def test_cluster_without_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session(_Context("yarn")))


def test_local_session_without_folder_gets_a_fresh_one():
    path = checkpoint_dir(_Session(_Context("local[2]")))
    assert "vocabshift-ckpt-" in path


def test_cluster_profile_enables_skew_and_sizes_partitions():
    assert int(CLUSTER_CONF["spark.sql.files.maxPartitionBytes"]) == 256 * 1024 * 1024
    assert int(CLUSTER_CONF["spark.sql.shuffle.partitions"]) >= 1000
    assert "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes" in CLUSTER_CONF
