import pytest

from callmetrics.llm import storage


class Fake:
    """A session of a cluster that names no shared folder."""

    master, conf = "spark://host:7077", {}
    sparkSession = sparkContext = property(lambda self: self)

    def getCheckpointDir(self):
        return None


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.checkpointed(Fake())
