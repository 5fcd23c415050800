"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from netweave.sources.scratch import shared_folder


def session(master, folder=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=context), made


def test_only_local_sessions_get_a_folder_of_their_own():
    for master in ("local", "local[4]", "local[*]"):
        spark, made = session(master)
        assert shared_folder(spark).startswith(made[0])
    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            shared_folder(session(master)[0])
        assert shared_folder(session(master, "hdfs://all/")[0]).startswith("hdfs://all/netweave-")
