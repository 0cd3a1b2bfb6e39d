import os

from tallyloom.operators import cuts


def test_a_scope_removes_what_was_written_in_it(spark):
    outer = cuts.durable(spark.range(3))
    with cuts.scope(spark):
        inner = cuts.durable(spark.range(5))
        path = cuts._made[-1].removeprefix("file:")
        assert inner.count() == 5 and os.path.isdir(path)
        with cuts.scope(spark):
            cuts.durable(spark.range(7))
    assert not os.path.isdir(path) and path not in [p.removeprefix("file:") for p in cuts._made] and outer.count() == 3
