"""Where intermediate tables go, by what the cluster names."""

import pytest

from pagemill import session


class Cluster:
    """A session as on a cluster: jobs run in the test session, and what they write may get lost."""

    def __init__(self, spark, folder, named=None, loses=False, warehouse=None):
        self._spark, self._folder, self._named, self._loses = spark, folder, named, loses
        self._warehouse = warehouse
        self.master, self.applicationId, self.defaultParallelism = "spark://head:7077", f"app-{folder}-{loses}", 4
        self.sparkContext = self.conf = self

    def get(self, key, default=None):
        return {"spark.checkpoint.dir": self._folder, "spark.sql.warehouse.dir": self._warehouse}.get(key, default)

    def getCheckpointDir(self):
        return self._named

    def range(self, start, end, step, tasks):
        return self._spark.range(start, end - 1 if self._loses else end, step, tasks)

    @property
    def read(self):
        return self._spark.read


def test_a_local_folder_that_all_reach_is_taken_on_a_cluster(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert session.shared_folder(Cluster(spark, folder)) == folder
    assert not list(tmp_path.iterdir())  # nothing is left of the trial
    assert session.shared_folder(Cluster(spark, None, folder)) == folder
    assert session.shared_folder(Cluster(spark, None, warehouse=folder)) == f"{folder}/pagemill-tables"
    assert session.shared_folder(Cluster(spark, "hdfs://head/tmp")) == "hdfs://head/tmp"


def test_a_local_folder_of_each_machine_is_refused_on_a_cluster(spark, tmp_path):
    for given in ({"folder": str(tmp_path)}, {"folder": None, "warehouse": str(tmp_path)}):
        with pytest.raises(RuntimeError, match="set spark.checkpoint.dir"):
            session.shared_folder(Cluster(spark, **given, loses=True))


def test_a_session_that_names_no_folder_has_one_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(spark.conf, "get", lambda key, default=None, get=spark.conf.get: default if key == "spark.checkpoint.dir" else get(key, default))
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    folder = session.shared_folder(spark)
    assert folder == session.shared_folder(spark)
    assert session.materialize(spark.range(3), "three").count() == 3


def test_a_cluster_on_one_machine_takes_the_warehouse(spark, tmp_path):
    made = Cluster(spark, None, warehouse=str(tmp_path))
    made.master = "local-cluster[3,2,3000]"
    assert session.shared_folder(made) == f"{tmp_path}/pagemill-tables"
