"""The search of nearest windows against all pairs: ties, copies, far values."""

import math

import numpy as np

from gridloom.operators import detect, nearest
from gridloom.plans.durable import keep


def test_leaves_find_what_all_pairs_find():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.integers(0, 4, (700, 3)) * 0.1, rng.normal(size=(200, 3)), rng.normal(size=(20, 3)) * 1e6, np.zeros((150, 3))])
    ids = rng.permutation(len(x)) + 10**12
    among = nearest.Among(x, ids)
    assert len(among.sizes) > 5 and among.sizes.max() <= nearest.LEAF and (among.low <= among.high).all()
    counts, other, d = among.nearest(7, x, ids)
    assert (counts == 7).all()
    for i, (o, far) in enumerate(zip(other.reshape(-1, 7), d.reshape(-1, 7), strict=True)):
        away = nearest.distances(np.repeat(x[i : i + 1], len(x), axis=0), x)
        order = np.lexsort((ids, away))
        order = order[order != i][:7]
        assert (ids[order] == o).all() and (away[order] == far).all()
    bound = d.reshape(-1, 7)[:, -1]
    again = among.nearest(7, x, ids, bound)
    assert all((a == b).all() for a, b in zip(again, (counts, other, d), strict=True))
    few = nearest.Among(x[:4], ids[:4]).nearest(7, x[:4], ids[:4])
    assert few[0].tolist() == [3] * 4
    assert nearest.Among(x[:0], ids[:0]).nearest(7, x[:2], ids[:2])[0].tolist() == [0, 0]


def test_windows_with_more_copies_than_neighbours(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile([0.5, 0.5], (40, 1)), np.tile([3.0, 1.0], (4, 1)), np.round(rng.normal(size=(76, 2)), 1)])
    x = np.column_stack([x[rng.permutation(len(x))], np.zeros(len(x))])
    x[:3, 2] = 9.0  # a column that hardly varies
    made = keep(spark.createDataFrame([(f"w{i}", *map(float, r)) for i, r in enumerate(x)], "win_id string, a double, b double, c double"))
    z = {r[0]: tuple(r)[1:] for r in detect.standardise(made).collect()}
    near = {a: sorted((math.dist(z[a], z[b]), b) for b in z if b != a)[:5] for a in z}
    lrd = {a: 1 / (sum(max(d, near[b][-1][0]) for d, b in near[a]) / 5 + 1e-10) for a in z}
    want = {a: sum(lrd[b] for _, b in near[a]) / 5 / lrd[a] for a in z}
    for cells in (1, 6):
        got = {r["win_id"]: r["score"] for r in detect.local_outlier_factor(made, k=5, cells=cells).collect()}
        assert got.keys() == want.keys() and all(abs(got[a] - want[a]) <= 1e-6 * want[a] for a in want)
    alone = made.filter("win_id = 'w0'")
    assert detect.local_outlier_factor(alone, k=5).count() == 0


def test_copies_beyond_the_first_dont_search(spark):
    made = keep(spark.range(300).selectExpr("concat('w', id) AS win_id", "if(id < 290, 1D, CAST(id AS double)) AS a"))
    first = detect._first_copies(detect._vectors(made), 5)
    assert first.filter("not ask").count() == 5 and first.filter("ask").count() == 10


def test_few_far_values_leave_cells_small(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(640, 2)), np.zeros((640, 2))])
    x[:4, 2], x[4:8, 3] = 1.0, 1.0
    f = keep(spark.createDataFrame([(f"w{i:03d}", *map(float, r)) for i, r in enumerate(x)], "win_id string, a double, b double, c double, e double"))
    assert detect.pairs_compared(f, 5, 27) < 640 * 640 / 5
