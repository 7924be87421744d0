import os

import pytest

from logfold import session


class Stub:
    """A session with the given master and no checkpoint folder."""

    def __init__(self, master):
        self.conf, self.sparkContext = self, self
        self.master, self.applicationId = master, "app"

    def get(self, key, default):
        return default


def test_scratch_follows_the_setting(spark, tmp_path, monkeypatch):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.scratch_path(spark, "x").startswith(configured)
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    table = session.materialize(spark.range(5), "five")
    assert table.count() == 5 and str(tmp_path) in table.inputFiles()[0]
    with session.scratch_scope(spark) as folder:
        assert session.materialize(spark.range(3)).count() == 3
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and table.count() == 5


def test_only_a_local_session_may_go_without():
    with pytest.raises(ValueError):
        session.scratch_root(Stub("yarn"))
    local = session.scratch_root(Stub("local[2]"))
    assert os.path.isdir(local) and session.scratch_root(Stub("local[2]")) == local
