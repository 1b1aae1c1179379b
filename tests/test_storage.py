"""The shared scratch space."""

from types import SimpleNamespace

import pytest

from skein.storage import materialize, scratch, shared_dir


def test_no_local_folder_on_a_cluster():
    none = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: none))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)


def test_scratch_is_dropped(spark):
    kept, _ = materialize(spark.range(3), "kept")
    with scratch(spark):
        inner, _ = materialize(spark.range(5), "inner")
        assert inner.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST"):
        inner.count()
