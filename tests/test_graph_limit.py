import pytest

from scholion.operators import graph


def test_bfs_does_not_end_short(spark):
    """A chain longer than the limit is an error, not a shorter walk."""
    edge = spark.createDataFrame([(1, k, k + 1) for k in range(4)], "doc_id long, src long, dst long")
    start = spark.createDataFrame([(1, 0)], "doc_id long, node_id long")
    assert graph.bfs(edge, start).count() == 5
    with pytest.raises(RuntimeError):
        graph.bfs(edge, start, limit=3)
