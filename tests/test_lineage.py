import os
from types import SimpleNamespace

import pytest

from linkforge import lineage


def test_written_tables_can_be_discarded(spark):
    df = lineage.written(spark.range(10), "some-table")
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert df.count() == 10 and "/some-table-" in folder
    lineage.discard(df)
    assert not os.path.exists(folder)


def test_other_files_are_not_discarded(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    lineage.discard(df)
    assert df.count() == 3


def test_a_cluster_needs_a_shared_folder():
    none = lambda *a: None
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True), isLocal=lambda: False)), getConf=lambda: SimpleNamespace(get=none))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage._folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=none)))
