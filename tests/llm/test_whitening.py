"""Whitening against numpy on the whole table, merges, and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from recallforge.llm import whitening as W
from tests.compare import SF


def plain(vectors, components=8):
    """deviations, whitened, explained of exact integers and two-pass covariance."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64).astype(object) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s) / n).astype(np.float64)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return [int(d) for d in ((n * x - s) ** 2).sum(axis=1)], centred @ axes[:, :components] / np.sqrt(values[:components]), values / values.sum()


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    far, white, explained = plain([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in W.op12_whitening(spark, SF).collect()}
    assert len(got) == 8 * len(rows)
    for c in range(8):
        mine = np.array([got[r.vec_id, c + 1].whitened for r in rows])
        assert min(abs(mine - white[:, c]).max(), abs(mine + white[:, c]).max()) < 1e-9
    for r, d in zip(rows, far, strict=True):
        assert got[r.vec_id, 1].deviation == got[r.vec_id, 8].deviation == d
    one = got[rows[0].vec_id, 3]
    assert one.n == len(rows) and abs(one.explained / explained[2] - 1) < 1e-9 and 0 <= one.identity_error < 1e-9


@pytest.mark.parametrize("parts", [1, 9, 40])
def test_odd_rows(spark, parts):
    """Nulls, not-finite entries, other lengths, repeated rows and ids, empty partitions,
    a large common offset, more partitions than one task of the tree merges."""
    rng = np.random.default_rng(parts)
    good = [[float(e) for e in v] for v in rng.normal(1000, [[1e-1, 3, 0.5]], (60, 3))]
    good += good[:5]
    odd = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e300, 1.0, 1.0], [1.0, 2.0], []]
    rows = [(k % 50 if k else None, v, "n") for k, v in enumerate(good)] + [(900 + k, v, "n") for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(parts)
    far, white, _ = plain(good, 3)
    got = sorted((str(r.key), int(r.deviation), tuple(round(abs(w), 6) for w in r.whitened)) for r in W.whiten(df).collect())
    assert got == sorted((str(k % 50 if k else None), d, tuple(round(abs(w), 6) for w in row)) for k, (d, row) in enumerate(zip(far, white.tolist(), strict=True)))


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)]):
        assert W.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 5.0]) for k in range(9)], schema)
    assert {len(r.whitened) for r in W.whiten(flat).collect()} == {1}
    assert flat.count() == 9 and W.whiten(flat).first().explained == [1.0]


def test_merging_is_exact_in_counts_and_close_in_scatter():
    rng = np.random.default_rng(2)
    x = rng.integers(99_000, 101_000, (5000, 6))
    total = W.Moments.of(x[:1])
    for k in range(1, 5000, 37):
        total = total.merged(W.Moments.of(x[k : k + 37]))
    assert total.n == 5000 and total.sums == x.sum(axis=0).tolist()
    centred = x - x.mean(axis=0)
    assert np.allclose(total.scatter, centred.T @ centred, rtol=1e-12)
    assert total.merged(W.Moments(0, [0] * 6, np.zeros((6, 6)))) is total


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[0, 10**6], [10**6, 0]])
    m = W.Moments.of(x)
    m.n, m.sums, m.scatter = 10**9, [s * 10**9 // 2 for s in m.sums], m.scatter * (10**9 / 2)
    want = [2 * (10**9 * 5 * 10**5) ** 2] * 2
    assert W.Whitening(m, 2).deviations(x) == want and want[0] > 1 << 63
