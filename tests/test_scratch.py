from types import SimpleNamespace

import pytest

from sedge.sources.scratch import scratch_root


def test_scratch_is_in_the_shared_folder(spark):
    assert spark.sparkContext.applicationId in scratch_root(spark)
    own = SimpleNamespace(applicationId="a", master="spark://host:7077")
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "file:///shared/"}, sparkContext=own)
    assert scratch_root(named) == "file:///shared/sedge-a"
    with pytest.raises(ValueError):
        scratch_root(SimpleNamespace(conf={}, sparkContext=own))
