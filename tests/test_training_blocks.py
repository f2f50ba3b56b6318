import numpy as np

from larder.operators import graph


def test_every_node_is_trained_in_every_block(spark, monkeypatch):
    pairs = [(f"u{i}", f"i{j}") for i in range(40) for j in range(10) if (i < 20) == (j < 5)]
    e = spark.createDataFrame(pairs, "user string, item string")
    monkeypatch.setattr(graph, "BLOCK_EDGES", 50)
    a, b = ({r.node: r.v for r in graph.train(e, dims=8, epochs=30).collect()} for _ in range(2))
    assert a == b
    assert set(a) == {f"u:{u}" for u, _ in pairs} | {f"i:{i}" for _, i in pairs}
    score = lambda u, i: float(np.dot(a[f"u:{u}"], a[f"i:{i}"]))
    for u in range(40):
        own = [score(f"u{u}", f"i{j}") for j in range(10) if (u < 20) == (j < 5)]
        other = [score(f"u{u}", f"i{j}") for j in range(10) if (u < 20) != (j < 5)]
        assert np.mean(own) > np.mean(other)
    assert graph.train(e.limit(0)).count() == 0
