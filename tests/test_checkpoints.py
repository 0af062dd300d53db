import pytest

from tidemark import checkpoints


class Held:
    """A session without any checkpoint folder."""

    def __init__(self, master):
        self.conf, self.sparkContext = self, self
        self.master, self._jsc, self.made = master, self, []

    def get(self, key, default=None):
        return default

    def getConf(self):
        return self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isEmpty(self):
        return True

    def setCheckpointDir(self, path):
        self.made.append(path)


def test_only_a_local_master_gets_a_folder_of_its_own():
    for master in ("local", "local[4]", "local[*]"):
        held = Held(master)
        assert [checkpoints.shared_dir(held)] == held.made
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoints.shared_dir(Held(master))
