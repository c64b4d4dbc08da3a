"""Jensen-Shannon distances by one logarithm an entry of a pair."""

import numpy as np

from tessera.operators import vector_index


def plain(q, x):
    with np.errstate(invalid="ignore", divide="ignore"):
        side = lambda a, b: np.where(a > 0, a * np.log(a / ((a + b) / 2)), 0)
        return np.array([0.5 * (side(x, v) + side(v, x)).sum(1) for v in q])


def test_distances_and_logarithms(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.random((300, 16)) * (rng.random((300, 16)) > 0.2)
    x[0] = 0
    x[1:] /= x[1:].sum(1)[:, None]
    q, taken, log = np.concatenate([x[:20], rng.random((5, 16))]), [], np.log
    for a, b in ((q, x), (q * 1e6, x * 1e6), (q, x - 0.01), (q[:0], x), (q, x[:0])):
        assert np.allclose(vector_index.distances(a, b, "jensen_shannon", 3), plain(a, b).reshape(len(a), len(b)), rtol=1e-9, atol=1e-13, equal_nan=True)
    assert (np.round(vector_index.distances(x[:20], x, "jensen_shannon", 3), 9)[range(20), range(20)] == 0).all()
    monkeypatch.setattr(np, "log", lambda y: taken.append(np.size(y)) or log(y))
    vector_index.distances(q, x, "jensen_shannon", 3)
    assert sum(taken) <= (len(q) * len(x) + len(q) + len(x)) * 16 + 2


def test_the_best_are_found_without_sorting_all(monkeypatch):
    rng, sort = np.random.default_rng(4), np.lexsort
    d = np.round(rng.random((30, 500)), 2)
    d[0] = np.nan
    d[1, 3:] = np.nan
    d[2] = np.inf
    ids = np.array([rng.permutation(500) for _ in d])
    for descending in (False, True):
        order = sort((ids, -d if descending else d), axis=1)[:, :4]
        got = vector_index.k_best(d, ids, 4, descending)
        assert np.array_equal(got[0], np.take_along_axis(d, order, 1), equal_nan=True) and (got[1] == np.take_along_axis(ids, order, 1)).all()
    assert vector_index.k_best(d[:, :2], ids[:, :2], 4, False)[0].shape == (30, 2) and vector_index.k_best(d[:0], ids[:0], 4, False)[0].shape == (0, 4)
    sizes = []
    monkeypatch.setattr(np, "lexsort", lambda keys, *a, **b: sizes.append(keys[0].size) or sort(keys, *a, **b))
    vector_index.k_best(d[3:], ids[3:], 4, False)
    assert sum(sizes) < 27 * 500 / 10
