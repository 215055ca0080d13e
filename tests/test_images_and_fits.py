import numpy as np
import pytest

from tesselq.operators import cluster, images


def test_kernels_against_loops(spark):
    rng = np.random.default_rng(0)
    a = rng.random((7, 9, 2))
    box, med, top = images.box_mean(a, 2), images.median(a, 1), images.maximum(a, 1)
    p = np.pad(a, ((1, 1), (1, 1), (0, 0)), "edge")
    for y in range(7):
        for x in range(9):
            assert box[y, x] == pytest.approx(a[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].mean((0, 1)))
            assert med[y, x] == pytest.approx(np.median(p[y : y + 3, x : x + 3], (0, 1))) and top[y, x] == pytest.approx(p[y : y + 3, x : x + 3].max((0, 1)))
    assert images.gaussian(np.ones((5, 5, 1)), 1.2) == pytest.approx(1) and images.triangle(np.ones((5, 5, 1)), 2) == pytest.approx(1)
    assert images.laplacian(np.ones((4, 4, 1))) == pytest.approx(0)
    assert images.resize(a, 7, 9) == pytest.approx(a) and images.warp(a, np.zeros((7, 9)), np.zeros((7, 9))) == pytest.approx(a)
    assert images.correlate(a[:, :, 0], a[2:5, 3:6, 0])[2, 3] == pytest.approx(1)
    assert [i.shape[1] for i in images.pyramid(np.ones((16, 16, 1)), 0.5, 4)] == [16, 8, 4]
    flat = np.full((9, 9, 3), 40.0)
    hot = flat.copy()
    hot[4, 4] = (90, 60, -60)
    assert images.repair_hot_pixels(hot) == pytest.approx(flat)
    assert images.gradient_histogram(a).shape == (1, 2, 9)


def test_map_images(spark):
    rows = [(1, 3, 2, 1, [float(i) for i in range(6)]), (2, 2, 2, 1, None)]
    df = spark.createDataFrame(rows, images.SCHEMA)
    out = {r["id"]: r for r in images.map_images(df, lambda a: images.resize(a, 4, 6)).collect()}
    assert (out[1]["w"], out[1]["h"], len(out[1]["data"])) == (6, 4, 24) and out[2]["data"] is None


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(c, 0.2, (n, 2)) for c, n in (((0, 0), 60), ((5, 5), 40), ((0, 9), 20))])
    found, centres = cluster.kmeans(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>"), 3)
    assert [r["n"] for r in centres.orderBy("id").collect()] == [60, 40, 20]
    assert len({r["centre"] for r in found.where("id < 60").collect()}) == 1


def test_colour_map_resists_wrong_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(20, 230, (600, 3))
    y = x * [0.9, 1.05, 1.0] + [10, -5, 3]
    y[::10] = rng.uniform(0, 255, (60, 3))
    pairs = spark.createDataFrame([("a", p.tolist(), q.tolist()) for p, q in zip(x, y)], "view string, target array<double>, palette array<double>")
    m = cluster.ColourMap()
    out = cluster.apply_colour_maps(pairs, cluster.fit_colour_maps(pairs, m), m).collect()
    error = np.asarray([np.abs(np.subtract(r["colour"], np.asarray(r["target"]) * [0.9, 1.05, 1.0] - [-10, 5, -3])).mean() for i, r in enumerate(out) if i % 10])
    assert error.mean() < 3
