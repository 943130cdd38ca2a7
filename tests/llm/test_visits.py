"""Queries on their way to shards: all that they visit, in batches of bounded size."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from airside.llm import ann


def test_visits_leave_in_bounded_batches():
    """2000 queries times 30 shards: every nearest cell with all its shards, never more than VISIT_ROWS rows at once."""
    rng, dim, cells = np.random.default_rng(1), 4, 20
    keys = [(i % 3, i) for i in range(cells)]
    held = SimpleNamespace(value={dim: (keys, rng.normal(size=(cells, dim)))})
    subs = {(dim, *k): 1 + i % 2 for i, k in enumerate(keys)}
    queries = pd.DataFrame({"query_id": np.arange(2000), "query": np.arange(2000) * 7, "vector": list(rng.normal(size=(2000, dim))), "dim": dim})
    for count in (cells, 3):
        batches = list(ann._visits(held, {dim: count}, subs)(iter([queries])))
        assert max(map(len, batches)) <= getattr(ann, "VISIT_ROWS", 8192)
        got = pd.concat(batches)
        nearest = np.argsort(-(np.stack(queries["vector"]) @ held.value[dim][1].T), axis=1, kind="stable")[:, :count]
        want = [(q, *keys[c], s) for q, row in enumerate(nearest) for c in row for s in range(subs[(dim, *keys[c])])]
        assert sorted(zip(got["query_id"], got["band"], got["cell"], got["sub"], strict=True)) == sorted(want)
        assert all(np.array_equal(v, queries["vector"][q]) for v, q in zip(got["vector"][:500], got["query_id"][:500], strict=True))
    counted = pd.concat(ann._visits(held, {dim: 3}, subs, False)(iter([queries])))
    assert list(counted.columns) == ann.SHARD and len(counted) == len(want)


def test_many_queries(spark, monkeypatch):
    """More queries than one task takes past a shard: the same neighbours as in one block."""
    from pyspark.sql import functions as F

    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.random.default_rng(2).normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    found = []
    for block in (16384, 10):
        monkeypatch.setattr(ann, "QUERY_BLOCK", block)
        found.append(sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 20 == 0, shard_rows=200).collect())))
    assert found[0] == found[1] and len(found[0]) == 600
