"""Where tables are written, that they go, and joins that deal hot keys."""

import os
from types import SimpleNamespace

import pytest

from plenum.llm import common


@pytest.mark.parametrize("master,folder,want", [("yarn", None, None), ("local-cluster[2,1,1024]", None, None), ("local[4]", None, "/plenum-checkpoint"), ("yarn", "hdfs://x/y/", "hdfs://x/y")])
def test_only_one_process_may_use_a_local_folder(master, folder, want):
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    if want is None:
        with pytest.raises(ValueError):
            common.scratch(fake)
    else:
        assert common.scratch(fake).endswith(want)


def test_discard(spark):
    df = common.cut(spark.range(3))
    path = common.WRITTEN[-1]
    assert df.count() == 3 and os.path.isdir(path)
    common.discard(spark, [path])
    assert not os.path.exists(path) and path not in common.WRITTEN


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(100).selectExpr("CASE WHEN id < 60 THEN 1 ELSE id END AS k", "id")
    keys = rows.groupBy("k").count().withColumnRenamed("count", "n")
    found = common.join_counted(rows, keys, ["k"], "id")
    assert sorted(found.columns) == ["id", "k", "n"] and found.count() == 100
    assert {r.n for r in found.filter("k = 1").collect()} == {60}
    assert common.join_counted(rows.limit(0), keys.limit(0), ["k"], "id").count() == 0
