from __future__ import annotations

import pytest

from linkloom import session


class Context:
    def __init__(self, master, configured=None, current=None):
        self.master, self.configured, self.current = master, configured, current

    def getConf(self):
        return {"spark.checkpoint.dir": self.configured} if self.configured else {}

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


class Session:
    def __init__(self, context):
        self.sparkContext, self.conf = context, {}


def test_the_configured_folder_is_used():
    context = Context("spark://head", "hdfs:///shared")
    assert session.shared_dir(Session(context)) == context.current == "hdfs:///shared"
    assert session.scratch_path(Session(context), "x").startswith("hdfs:///shared/x-")


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError):
        session.shared_dir(Session(Context("spark://head")))


def test_a_local_session_gets_its_own_folder():
    context = Context("local[2]")
    assert session.shared_dir(Session(context)) == context.current
