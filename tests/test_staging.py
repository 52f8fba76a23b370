import pytest

from attesta.operators import staging


class Session:
    """What ``scratch_root`` reads of a session."""

    def __init__(self, root, master):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": root}, type("C", (), {"master": master})


def test_root_comes_from_the_session_and_is_never_set():
    assert staging.scratch_root(Session("file:///shared/", "yarn")) == "file:///shared"
    local = Session(None, "local[2]")
    assert staging.scratch_root(local) == staging.scratch_root(local)
    assert local.conf == {"spark.checkpoint.dir": None}
    with pytest.raises(ValueError):
        staging.scratch_root(Session(None, "yarn"))


def test_stage_keeps_rows(spark):
    assert staging.stage(spark.range(5), "five").count() == 5
