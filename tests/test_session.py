"""The shared folder: read from the session, refused off a local master."""

import os

import pytest

from churnwise import session


class _Context:
    def __init__(self, master, current=None):
        self.master, self.current = master, current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, d):
        self.current = d


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default


class _Session:
    def __init__(self, master, value=None, current=None):
        self.sparkContext, self.conf = _Context(master, current), _Conf(value)


def test_folder_comes_from_the_session():
    assert session.checkpoint_dir(_Session("yarn", current="hdfs://c/x")) == "hdfs://c/x"
    assert session.checkpoint_dir(_Session("yarn", value="hdfs://c/y")) == "hdfs://c/y"


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Session(master))


def test_scratch_is_removed(spark, tmp_path):
    path = session.scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    session._remove(spark, path)
    assert not os.path.exists(local)


def _persisted(spark) -> int:
    return spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_kept_tables_go(spark):
    spark.catalog.clearCache()
    with session.kept(spark.range(5), spark.range(3)) as (a, b):
        out = session.finished(a.join(b, "id"))
        assert a.is_cached and _persisted(spark) > 0
    assert out.count() == 3 and _persisted(spark) == 0
    with pytest.raises(ZeroDivisionError):
        with session.kept(spark.range(5)) as (a,):
            a.count()
            1 / 0
    assert _persisted(spark) == 0


def test_finished_keeps_an_order(spark):
    df = session.finished(spark.range(100).orderBy(session.F.desc("id")), ordered=True)
    assert [r["id"] for r in df.collect()] == list(range(99, -1, -1))


@pytest.mark.parametrize("name", ["box_purchase", "quality_report", "csv_round_trip", "train_evaluate", "model_scores"])
def test_queries_leave_nothing_kept(spark, name):
    from churnwise.plans import catalog
    spark.catalog.clearCache()
    catalog.REGISTRY[name].run(spark, "/root/testdata/sf0.001").collect()
    assert _persisted(spark) == 0


def test_models_follow_their_files(spark, tmp_path):
    """A model is trained once, and again after its files have changed under the same path."""
    path = str(tmp_path / "t.parquet")
    models, trained = session.FittedModels(), []

    def get(name="m"):
        return models.get(spark, name, [path], lambda: trained.append(name) or len(trained))

    spark.range(5).write.parquet(path)
    assert (get(), get(), get("other"), get()) == (1, 1, 2, 1)
    spark.range(6).write.mode("overwrite").parquet(path)
    assert (get(), get()) == (3, 3)
    spark.range(1).write.mode("append").parquet(path)
    assert get() == 4
    models.clear()
    assert get() == 5
