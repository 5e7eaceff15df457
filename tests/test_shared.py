import os

from seqspark.sources import shared


def test_tables_are_stored_discarded_and_cleared(spark):
    first, second = (shared.stored(spark.range(3), name) for name in ("a", "b"))
    paths = [x._stored_path.removeprefix("file://") for x in (first, second)]
    assert all(map(os.path.isdir, paths)) and second.count() == 3 and paths[0].startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    shared.discard(first)
    assert [os.path.isdir(p) for p in paths] == [False, True]
    shared.clear(spark)
    assert not os.path.isdir(paths[1])
