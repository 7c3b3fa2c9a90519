"""Staged tables never go to a folder of one machine on a cluster."""

import pytest

from tideglass.llm import _common


class Session:
    def __init__(self, **conf):
        self.conf = {f"spark.{k.replace('_', '.')}": v for k, v in conf.items()}


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_unset_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(Session(master=master))


def test_set_folder():
    assert _common.shared_dir(Session(master="yarn", checkpoint_dir="hdfs://store/x")) == "hdfs://store/x"


def test_local_mode():
    assert _common.shared_dir(Session(master="local[2]"))
