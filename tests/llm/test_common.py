import os
from types import SimpleNamespace

import pytest

from quillspark.llm import common


def test_no_local_folder_on_a_cluster():
    def session(master, folder=None):
        conf = {"spark.master": master, "spark.checkpoint.dir": folder}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k) or d), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "hdfs://shared")) == "hdfs://shared"
    assert common.shared_dir(session("local[4]")).startswith("file://")


def there(df):
    return os.path.isdir(df._quill_path.removeprefix("file:").replace("///", "/").replace("//", "/"))


def test_scratch_removes_what_isnt_kept(spark):
    with common.scratch(spark) as keep:
        gone = common.stored(spark.range(3), "a")
        with common.scratch(spark) as inner:
            kept = keep(inner(common.stored(gone.filter("id > 0"), "b")))
            lost = common.stored(spark.range(1), "c")
        assert there(gone) and there(kept) and not there(lost)
    assert not there(gone) and there(kept) and kept.count() == 2
    with pytest.raises(ValueError), common.scratch(spark):
        broken = common.stored(spark.range(1), "d")
        raise ValueError
    assert not there(broken)
    common.discard(kept)
    assert not there(kept)


def test_free_names():
    assert common.free_name("gone", ["a"]) == "gone" and common.free_name("gone", ["Gone", "gone_"]) == "gone__"
