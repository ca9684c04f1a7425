import os

from lodestar import storage


def test_written_tables_are_released(spark):
    storage.release(spark)
    df = storage.materialise(spark.range(3), "x")
    path = storage._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    assert storage.release(spark) == 1 and not os.path.exists(path) and storage.release(spark) == 0
