import tracemalloc

import numpy as np
import pyarrow as pa

from attesta.operators import neighbours as nb


def test_a_tile_takes_little_more_than_its_vectors():
    """The distance matrix of a strip bounds a task's memory; a row of the result is no table of its own."""
    x = np.random.default_rng(5).normal(size=(6_000, 64))
    rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))
    ids = pa.array(np.arange(len(x)))
    tracemalloc.start()
    row, at, dist = nb._tile_nearest(pa.table({"query_id": ids, "vector": rows}), pa.table({"vec_id": ids, "vector": rows}), 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    assert len(row) == 5 * len(x) and not (row == at).any()
    one = ((x[17] - x) ** 2).sum(1)
    assert set(at[row == 17]) == set(np.argsort(one)[1:6])


def test_rough_distances_lose_no_neighbour():
    """Single precision only leaves out what is farther by more than its margin: far from the origin, with ties, and in small tables."""
    rng = np.random.default_rng(5)
    for n, shift, step in ((9_000, 0.0, 0.0), (9_000, 1e4, 0.0), (5_000, 0.0, 0.5), (3, 0.0, 0.0)):
        x = rng.random((n, 8)) if not step else np.round(rng.random((n, 8)) * 2) * step     # coarse: many equal distances
        x = x + shift
        ids = rng.permutation(n)
        q = x[:70] if n > 70 else x
        row, at, dist = nb._tile_nearest(pa.table({"query_id": ids[:len(q)], "vector": list(q)}), pa.table({"vec_id": ids, "vector": list(x)}), 5, True)
        exact = np.round(((q[:, None, :] - x[None, :, :]) ** 2).sum(2), 6)
        exact[np.arange(len(q)), np.arange(len(q))] = np.inf
        want = [(i, ids[j]) for i in range(len(q)) for j in np.lexsort((ids, exact[i]))[:min(5, n - 1)]]
        if not shift:       # there the old formula itself is rounded
            assert list(zip(row, ids[at])) == want
        assert np.allclose(dist, [exact[i, np.flatnonzero(ids == j)[0]] for i, j in want], atol=1e-5 if shift else 1e-6)


def test_rough_distances_bound_what_they_leave_out():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(500, 64)) * 40 + 300, rng.normal(size=(20, 64)) * 40 + 300
    rough = nb.Rough(x)
    far, margin = rough(q, 0.0)
    exact = ((q[:, None, :] - x[None, :, :]) ** 2).sum(2) / rough.scale**2
    apart = far.astype(float) - exact
    assert (np.ptp(apart, axis=1) <= margin[:, 0]).all()
