import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embeddings as em


def brute(rows, least=0.95):
    ids = [i for i, _ in rows]
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    fine = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and fine[a] and fine[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float64) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                near[a, b] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least
    label = np.array(ids)
    while True:
        new = np.array([min([label[a], *label[near[a]]]) for a in range(len(rows))])
        if (new == label).all():
            return {i: (int(near[a].sum()), int(label[a]), bool(label[a] == i)) for a, i in enumerate(ids)}
        label = new


def made(seed=1, dims=24):
    rng = np.random.default_rng(seed)
    rows = [v for v in rng.normal(size=(60, dims))]
    for k in range(60):
        for _ in range(rng.integers(0, 5)):
            rows.append(rows[k] + rng.normal(size=dims) * rng.choice([0.0, 0.02, 0.1, 0.2]))
    rows += [rows[0] * 3, rows[0] * 1e200, rows[1] * 1e-200, np.zeros(dims), rows[2][:-1]]
    out = [(i, [float(c) for c in v]) for i, v in enumerate(rows)]
    n = len(out)
    return out + [(n, None), (n + 1, []), (n + 2, [float("nan")] * dims), (n + 3, [1.0, None]), (n + 4, [2.0]), (n + 5, [5.0]), (n + 6, [-1.0])]


@pytest.mark.parametrize("block", [1024, 4])
def test_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(em, "BLOCK", block)
    rows = made(seed=block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(7)).repartition(3)
    got = {r.id: (r.n_links, r.component, r.kept) for r in em.near_dedup(df).collect()}
    assert got == brute(rows)


def test_a_large_group_is_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(em, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=32)
    x = np.concatenate([centre + rng.normal(size=(150, 32)) * 0.05, rng.normal(size=(50, 32))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {r.id: (r.n_links, r.component, r.kept) for r in em.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(rows)


def test_list_decoding_finds_the_best():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = em.codebooks(10, 12, blocks=3)
    codes = em.list_decode(x, books, 9)
    parts = np.split(x, np.cumsum([b.shape[1] for b in books])[:-1], axis=1)
    s = [p @ b.T for p, b in zip(parts, books)]
    every = (s[0][:, :, None, None] + s[1][:, None, :, None] + s[2][:, None, None, :]).reshape(20, -1)
    assert all(set(c) == set(np.argsort(-e)[:9]) for c, e in zip(codes.tolist(), every))


def test_recall_at_the_bound():
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=(2, 4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    books = em.codebooks(64, 1100)
    a, b = em.list_decode(x, books, em.FILTERS), em.list_decode(y, books, em.FILTERS)
    assert min(len(np.intersect1d(p, q)) for p, q in zip(a, b)) >= em.SHARED


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.id or 0, r.n_links, r.component or 0, r.kept) for r in em.near_dedup(df).collect()))
    assert got == [(0, 0, 0, True), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True)]
    assert em.near_dedup(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("dims", [1, 2, 3, 4, 8])
def test_few_dimensions_lose_no_links(spark, dims):
    x, y = em.pairs_at(0.9501, dims, 150, seed=8)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate([x, y]))]
    got = {r.id: (r.n_links, r.component, r.kept) for r in em.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("dims, count, pairs", [(64, 28_000, 3000), (64, 6_250_000, 500), (64, 1_100_000_000, 40), (16, 28_000, 3000), (16, 30_000_000, 500), (8, 30_000_000, 1000), (2, 1_000_000, 1000), (768, 10_000, 500)])
def test_planned_recall(dims, count, pairs):
    codebook, n = em.plan(dims, count, 0.95)
    print(dims, count, codebook, n)
    x, y = em.pairs_at(0.95, dims, pairs, seed=9)
    x[:, : dims // 2] *= 0.01  # one block of the product code has hardly any weight
    y[:, : dims // 2] *= 0.01
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    near = (x * y).sum(axis=1) >= 0.95
    assert em.shared_filters(x[near], y[near], em.tables(dims, codebook, n)).min() >= em.SHARED
