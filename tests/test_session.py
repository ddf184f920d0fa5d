"""The shared checkpoint folder."""

from types import SimpleNamespace

import pytest

from shopframe.session import ensure_checkpoint_dir


def fake(master, conf=None, current=None):
    conf, made = conf or {}, []
    sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: made[-1] if made else current,
                         setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_cluster_needs_a_named_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake(master))
    assert ensure_checkpoint_dir(fake(master, {"spark.checkpoint.dir": "hdfs:///c"})) == "hdfs:///c"


def test_local_makes_one(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    assert ensure_checkpoint_dir(fake("local[2]")).startswith(str(tmp_path))
