import os

from fewlabel import session


def test_written_steps_can_be_dropped(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "scratch")
    monkeypatch.setattr(session, "scratch_root", lambda s: root)
    df = session.durable(spark.range(10), "step")
    assert df.count() == 10 and df.inputFiles() and os.listdir(root)
    session.drop_scratch(spark)
    assert not os.path.exists(root)


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_spread_leaves_enough_splits_alone(spark):
    wide = spark.range(100, numPartitions=20)
    assert session.spread(wide) is wide
    assert session.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() >= 8
