"""Session helpers: shared checkpoint folder, spreading, path handling."""

import pytest

from contactlake.session import checkpoint_dir, posix_path, scratch_path, spread


def test_posix_path():
    assert posix_path("file:/tmp/x") == "/tmp/x"
    assert posix_path("file:///tmp/x") == "/tmp/x"
    assert posix_path("/tmp/x") == "/tmp/x"
    with pytest.raises(ValueError):
        posix_path("s3a://bucket/x")


def test_checkpoint_dir_reused(spark):
    d = checkpoint_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x").startswith(d)


def test_spread_only_when_needed(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one, 4).rdd.getNumPartitions() == 4
    many = spark.range(100).repartition(6)
    assert spread(many, 4) is many
