"""Nearest neighbours against brute force: given vectors, outliers, clusters, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airside.llm import ann
from airside.llm.common import table


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        with np.errstate(over="ignore", invalid="ignore"):
            s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def recall(spark, ids, x, **how):
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(ids, x, [n for n, i in enumerate(ids) if i % 20 == 0])
    assert set(got) == set(want)
    at = {int(i): n for n, i in enumerate(ids)}
    for q, rows in got.items():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, len(want[q]) + 1))
        assert all(np.isclose(s, x[at[q]] @ x[at[v]], rtol=1e-9) for _, v, s in rows)
    return np.mean([len(set(want[q]) & {v for _, v, _ in got[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize(("sf", "rows", "shard_rows"), [("sf0.01", None, 8192), ("sf0.1", 2000, 500)])
def test_recall_on_given_vectors(spark, sf, rows, shard_rows):
    t = table(spark, f"/root/testdata/{sf}", "embeddings").orderBy("vec_id").toPandas()
    t = t[[v is not None and len(v) == 64 for v in t["embedding"]]].head(rows or len(t))
    x = np.stack(t["embedding"].to_numpy()).astype(float)
    keep = np.isfinite(x).all(1) & (np.abs(x).max(1) > 0)
    assert recall(spark, t["vec_id"].to_numpy()[keep], x[keep], shard_rows=shard_rows) >= 0.93


def test_recall_on_unit_vectors_in_three_shards(spark):
    x = np.random.default_rng(8).normal(size=(6000, 64))
    assert recall(spark, np.arange(6000), x / np.linalg.norm(x, axis=1, keepdims=True), shard_rows=2000) >= 0.93


@pytest.mark.parametrize("scale", [1e4, 1e20, 1e-300])
def test_an_outlier_blurs_nothing(spark, scale):
    x = np.random.default_rng(5).normal(size=(1500, 16))
    x[7] *= scale
    x[40] = x[41] * scale
    assert recall(spark, np.arange(1500), x, shard_rows=500) >= 0.95


def test_clusters_need_few_visits(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 16))[np.arange(2400) % 12] * 3 + rng.normal(size=(2400, 16)) * 0.3
    seen = []
    real = ann.probes
    monkeypatch.setattr(ann, "probes", lambda *a: seen.append(real(*a)) or seen[-1])
    assert recall(spark, np.arange(2400), x, shard_rows=200) >= 0.95
    assert seen[0][16] <= 4  # of 12 cells


def test_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], "s") for i in range(30)] + [(20, [0.0, 1.0], "again"), (20, [1.0, 0.0], "other"), (99, [1.0, 2.0, 3.0], "long"), (None, [1.0, 1.0], "no id")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 1.0), (4, 1.0), (6, 1.0), (8, 1.0), (10, 1.0)]
    both = ann.search(df, F.col("vec_id") == 20, k=40).collect()
    assert len(both) == 2 * 29  # a query for each of its two vectors; its own rows are no candidates
    assert ann.search(df, F.col("vec_id") == 99).count() == 0
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
