"""The folder of intermediate tables."""

import os
from types import SimpleNamespace

import pytest

from bindery.llm._store import release, shared_folder, written


def session(master: str, folder: str | None = None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    held = SimpleNamespace(get=conf.get, set=conf.__setitem__)
    return SimpleNamespace(conf=held, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None)))


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"))
    assert shared_folder(session("spark://host:7077", "hdfs://shared/x")) == "hdfs://shared/x"
    alone = session("local[2]")
    assert shared_folder(alone) == shared_folder(alone)


def test_a_table_goes_when_it_is_released(spark):
    frame = written(spark.range(5).toDF("a"))
    place = frame.stored_at.removeprefix("file://").removeprefix("file:")
    assert frame.count() == 5 and os.path.isdir(place)
    release(frame)
    assert not os.path.exists(place)
