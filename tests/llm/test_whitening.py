"""Whitening against numpy's eigenvectors, exact integers and matrices with known factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import embedding_whitening as ew

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def expected(vectors):
    """n, per-vector deviations, whitened values and explained shares, by plain numpy on exact integers."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0).astype(object)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    centred = x - (sums / n).astype(np.float64)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    kept = min(8, int((values > 1e-9 * values[0]).sum()))
    return n, deviation, centred @ directions[:, :kept] / np.sqrt(values[:kept]), values[:kept] / values.sum()


def check(rows, ids, vectors):
    n, deviation, whitened, explained = expected(vectors)
    kept = whitened.shape[1]
    assert len(rows) == n * kept
    by = {(r["vec_id"], r["component"]): r for r in rows}
    got = np.array([[by[i, c + 1]["whitened"] for c in range(kept)] for i in ids])
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.allclose(got * signs, whitened, rtol=0, atol=1e-8)
    for place, i in enumerate(ids):
        for c in range(kept):
            row = by[i, c + 1]
            assert row["n"] == n and row["deviation"] == deviation[place] and row["identity_error"] < 1e-9
            assert row["explained"] == pytest.approx(explained[c], rel=1e-9)


@pytest.mark.parametrize("size,rank", [(1, 1), (2, 2), (7, 7), (16, 5), (33, 33)])
def test_factor_and_rotations(size, rank):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(size, rank)) * np.logspace(0, -5, rank)
    scatter = base @ base.T
    factor = ew.pivoted_cholesky(scatter)
    assert factor.shape[1] <= size and np.allclose(factor @ factor.T, scatter, atol=1e-12 * scatter.max())
    directions, values = ew.jacobi(factor)
    assert np.allclose(directions.T @ directions, np.eye(len(values)), atol=1e-12)
    assert np.all(np.diff(values) <= 0)
    assert np.allclose(values[:rank], np.linalg.svd(base, compute_uv=False)[:len(values)] ** 2, rtol=1e-6)
    assert ew.pivoted_cholesky(np.zeros((size, size))).shape == (size, 0)


def test_whole_table_against_numpy(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in table.collect()}
    found = ew.whitened_vectors(table.repartition(5))
    assert found.columns == COLUMNS
    check(found.collect(), list(rows), list(rows.values()))


def test_rows_left_out_and_odd_tables(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(30, 3)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 1.0]]
    rows = [(k, v, "x") for k, v in enumerate(good)] + [(100 + k, v, "x") for k, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    found = ew.whitened_vectors(table).collect()
    check(found, list(range(30)), good)
    # Vectors of another length are a table of their own; one vector alone has no variance.
    mixed = table.union(spark.createDataFrame([(500, [1.0, 2.0], "y")], table.schema))
    check(ew.whitened_vectors(mixed).collect(), list(range(30)), good)
    assert ew.whitened_vectors(table.limit(0)).count() == 0
    same = table.where("vec_id = 3").select(F.explode(F.array_repeat("vec_id", 4)).alias("vec_id"), "embedding")
    assert ew.whitened_vectors(same).count() == 0


def test_constant_dimensions_repeated_rows_and_null_keys(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(a), 5.0, float(a + b), float(b)] for a, b in rng.integers(-9, 9, (40, 2))]
    rows = [(k, v) for k, v in enumerate(vectors)]
    check(ew.whitened_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), list(range(40)), vectors)
    repeated = spark.createDataFrame([(None, v) for _, v in rows] + [(7, v) for _, v in rows], "vec_id long, embedding array<double>")
    found = ew.whitened_vectors(repeated).collect()
    assert len(found) == 160 and {r["n"] for r in found} == {80} and {r["vec_id"] for r in found} == {None, 7}


def test_entries_beyond_integers_and_deviations_beyond_64_bits(spark):
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [3.0, 2.0])]
    found = ew.whitened_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in found if r["vec_id"] < 2} == {None} and all(np.isfinite(r["whitened"]) for r in found)
    large = [(k, [float(v), 1.0]) for k, v in enumerate((-400_000, 0, 400_000))]
    found = ew.whitened_vectors(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
    check(found, [0, 1, 2], [v for _, v in large])
