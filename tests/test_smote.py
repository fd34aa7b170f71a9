import random

import numpy as np

from nocturne.operators import learning as L


def test_made_rows_lie_between_nearest_neighbours(spark):
    r = random.Random(6)
    rows = [(i, 1.0, float(r.randint(0, 9)), r.gauss(0, 100), r.gauss(0, 1)) for i in range(90)] + [(i, 0.0, r.random(), r.random(), 3.0) for i in range(90, 300)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double, c double").repartition(3)
    x = np.array([v[2:] for v in rows])
    z = (x - x.mean(0)) / x.std(0)
    far = ((z[:90, None] - z[None, :90]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    want = {i: np.lexsort((np.arange(90), far[i]))[:5] for i in range(90)}
    scaled = spark.createDataFrame([(i, *map(float, z[i])) for i in range(90)], "id long, a double, b double, c double")
    for band in (10, 1024):  # several bands and one give the same
        got = {v.id: np.array(v.near) for v in L.neighbours(scaled, "id", ["a", "b", "c"], 5, band).collect()}
        assert set(got) == set(want) and all(np.allclose(got[i], z[want[i]]) for i in want)
    out = [v for v in L.smote(df, "y", "id", ["a", "b", "c"]).collect() if v.y == 1.0]
    assert len(out) == 210
    made = [v for v in out if not np.allclose([v.a, v.b, v.c], x[v.id])]
    assert len(made) >= 119
    for v in made:
        p, steps = np.array([v.a, v.b, v.c]) - x[v.id], x[want[v.id]] - x[v.id]
        u = [(p / x.std(0)) @ (s / x.std(0)) / ((s / x.std(0)) ** 2).sum() for s in steps]
        assert any(0 <= t <= 1 and np.allclose(p, t * s) for t, s in zip(u, steps))
