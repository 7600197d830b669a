import types

import pytest

from lodestep import session


def fake(master, settings):
    conf = types.SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__)
    sc = types.SimpleNamespace(master=master, getConf=lambda: conf, setCheckpointDir=lambda p: None)
    return types.SimpleNamespace(sparkContext=sc, conf=conf)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake(master, {}))
    assert session.shared_dir(fake(master, {"spark.checkpoint.dir": "hdfs://there/"})) == "hdfs://there"


def test_a_local_session_gets_a_folder_of_its_own():
    assert session.shared_dir(fake("local[4]", {})).startswith("file://")


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    session.ship(spark)
    assert spark.conf.get(limit).rstrip("b") == str(session.BATCH_BYTES)
    spark.conf.set(limit, "1048576")
    session.ship(spark)
    assert spark.conf.get(limit).rstrip("b") == "1048576"
    spark.conf.set(limit, session.BATCH_BYTES)
