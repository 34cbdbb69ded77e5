import numpy as np

from peerlens.operators.neighbours import nearest


def test_blocks_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(120)] + [(200, 0, [0.0] * 5), (201, 9, [1.0] * 5), (202, 0, None), (203, None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, g int, v array<float>").repartition(4)
    for block in (7, 1000):
        out = nearest(df, "g", "id", "v", 3, block=block)
        assert "CartesianProduct" not in out._jdf.queryExecution().toString()
        got = {}
        for r in out.orderBy("id", "place").collect():
            got.setdefault(r["id"], []).append((r["other"], r["cosine"]))
        for i, g, v in rows:
            if v is None or g is None:
                assert i not in got
                continue
            unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1.0)
            fellows = sorted((-round(float(unit(v) @ unit(w)), 6), j) for j, h, w in rows if h == g and j != i and w is not None)[:3]
            assert got.get(i, []) == [(j, -c + 0.0) for c, j in fellows], i


def test_nothing(spark):
    assert nearest(spark.createDataFrame([], "id long, g int, v array<float>"), "g", "id", "v", 3).count() == 0
