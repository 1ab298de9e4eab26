import numpy as np
import pyarrow as pa

from tracewell.llm import embedding_dedup as E


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1):
        centre = rng.normal(size=(40, 32))
        for k in range(900):
            v = centre[k % 40] + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.3])
            rows.append((label * 1000 + k, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), label))
    rows += [(5000 + k, rows[3][1], 0) for k in range(20)]
    rows += [(6000, None, 0), (6001, [], 0), (6002, [0.0] * 32, 0), (6003, [float("nan")] + [1.0] * 31, 0), (6004, [1.0] * 31 + [None], 0), (6005, rows[3][1], None), (6006, [1.0, 2.0], 0), (6007, [2.0, 4.0], 0), (None, [9.0] * 32, 1), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as key", "3 as kept")
    got = sorted((tuple(r) for r in E.link_vectors(df).collect()), key=str)
    good = [(k, r) for k, r in enumerate(rows) if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links = {k: set() for k in range(len(rows))}
    for a, ra in good:
        for b, rb in good:
            if a < b and ra[2] == rb[2] and len(ra[1]) == len(rb[1]):
                x, y = np.float64(ra[1]), np.float64(rb[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a].add(b)
                    links[b].add(a)
    found = sum(r[1] for r in got)
    assert found >= 0.99 * sum(map(len, links.values()))
    low = {}
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        low[a] = min(ids, default=None)
    want = sorted(((r[0], len(links[k]), low[k], low[k] == r[0]) for k, r in enumerate(rows)), key=str)
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(rows)
    assert E.link_vectors(df.limit(0)).count() == 0


def test_null_and_repeated_ids_and_extreme_values(spark):
    def links(rows):
        df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
        return sorted((tuple(r) for r in E.link_vectors(df).collect()), key=str)

    assert links([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.01])]) == [(1, 2, 1, True), (None, 2, 1, False), (None, 2, 1, False)]
    assert links([(None, [1.0, 0.0]), (None, [1.0, 0.0])]) == [(None, 1, None, True)] * 2
    got = links([(5, [0.0, 1.0]), (5, [-1.0, 0.0]), (6, [0.0, 1.0]), (7, [0.0, 1.001]), (8, [-1.0, 0.001])])
    assert got == [(5, 1, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (8, 1, 5, False)]
    tiny, huge = [1e-200, 0.0], [1e200, 1e190]
    assert links([(1, tiny), (2, [2e-200, 0.0]), (3, huge), (4, [0.0, 5e-324]), (5, [0.0, 1e308])]) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_vectors_keep_their_values():
    rows = [np.array([0.5, -2.0]), np.array([0.1, 1e300]), np.array([1e-300, 3.0])]
    for part in (rows[:1], rows):
        assert (E.unpacked(pa.array([E.packed(x) for x in part]), 2) == np.array(part)).all()
    assert [len(E.packed(x)) for x in rows] == [8, 16, 16]


def test_collisions_are_window_counts():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=(40, 5))
    assert (E.collisions(x, y, 0.4) == (np.abs(x[:, None] - y[None]) <= 0.4).sum(2)).all()


def test_calibration():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1)[:, None]
    u = E.directions(64, E.PROJECTIONS, 2)
    count = (np.abs(x @ u - y @ u) <= E.WIDTH * np.sqrt(2 - 2 * 0.93)).sum(1)
    assert (count >= E.least_collisions()).mean() > 0.995
