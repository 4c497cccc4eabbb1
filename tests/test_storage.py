import os

import pytest

from emberlog.storage import fresh_dir, scratch


def test_scratch_deletes_what_was_given_inside(spark):
    before = fresh_dir(spark, "before")
    spark.range(3).write.parquet(before)
    with scratch(spark):
        inside, never = fresh_dir(spark, "inside"), fresh_dir(spark, "never")
        spark.range(3).write.parquet(inside)
        with scratch(spark):
            spark.range(1).write.parquet(deeper := fresh_dir(spark, "deeper"))
        assert os.path.exists(inside) and not os.path.exists(deeper)
    assert not os.path.exists(inside) and not os.path.exists(never)
    assert spark.read.parquet(before).count() == 3


def test_scratch_leaves_folders_after_an_error(spark):
    with pytest.raises(ValueError), scratch(spark):
        spark.range(3).write.parquet(path := fresh_dir(spark, "inside"))
        raise ValueError
    assert os.path.exists(path)
    after = fresh_dir(spark, "after")
    with scratch(spark):
        pass
    spark.range(1).write.parquet(after)
    assert os.path.exists(after)
