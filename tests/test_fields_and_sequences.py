import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselq.operators import cluster, fields, registration, statistics
from tesselq.sources import sequences


def swept(cost, seeds, sweeps):
    """Pixel by pixel."""
    h, w = cost.shape
    far, label = np.where(seeds >= 0, 0.0, 1e10), seeds.copy()
    for n in range(sweeps):
        dy, dx = ((1, 1), (-1, 1), (-1, -1), (1, -1))[n % 4]
        for i in range(h)[::dy]:
            for j in range(w)[::dx]:
                up, left = (far[i - dy, j], label[i - dy, j]) if 0 <= i - dy < h else (1e10, -1), (far[i, j - dx], label[i, j - dx]) if 0 <= j - dx < w else (1e10, -1)
                near, gap = min(up, left, key=lambda t: t[0]) if up[0] != left[0] else left, abs(up[0] - left[0])
                t = near[0] + cost[i, j] if gap > cost[i, j] else (up[0] + left[0] + (2 * cost[i, j] ** 2 - gap**2) ** 0.5) / 2
                if t < far[i, j]:
                    far[i, j], label[i, j] = t, near[1]
    return far, label


def test_geodesic_sweeps():
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (1, 7), (9, 13), (12, 5)):
        cost = rng.uniform(0.1, 3, (h, w))
        seeds = np.full((h, w), -1)
        seeds.flat[rng.choice(h * w, max(1, h * w // 20), replace=False)] = np.arange(max(1, h * w // 20))
        far, label = fields.geodesic(cost, seeds, least=1e11)
        want, names = swept(cost, seeds, 4)
        assert np.allclose(far, want) and (label == names).all()
        settled = fields.geodesic(cost, seeds, least=0.0)[0]
        assert (settled <= far + 1e-12).all() and np.allclose(settled, swept(cost, seeds, 40)[0])
    assert (fields.geodesic(np.ones((2, 3)), np.full((2, 3), -1))[0] >= fields.FAR).all()


def test_barrier_distance():
    image = np.asarray([[0, 0, 5, 0], [0, 9, 5, 0], [0, 0, 0, 0]], float)
    far, label = fields.barrier(image, [(0, 0)])
    # Round the wall by the last row, through it at its least height.
    assert (far == np.asarray([[0, 0, 25, 0], [0, 81, 25, 0], [0, 0, 0, 0]])).all() and (label == 0).all()
    far, label = fields.barrier(image, [(0, 0), (3, 0)], factor=1e-3)
    assert label[0].tolist() == [0, 0, label[0, 2], 1] and label[2, 3] == 1
    assert np.isinf(fields.barrier(image, [])[0]).all()


def test_regions_and_superpixels():
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 3, (17, 23))
    part = fields.regions(labels)
    seen = np.full(labels.shape, -1)
    n = 0
    for i in range(17):
        for j in range(23):
            if seen[i, j] < 0:
                todo = [(i, j)]
                seen[i, j] = n
                while todo:
                    a, b = todo.pop()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < 17 and 0 <= d < 23 and seen[c, d] < 0 and labels[c, d] == labels[a, b]:
                            seen[c, d] = n
                            todo.append((c, d))
                n += 1
    assert (part == seen).all()
    assert np.bincount(fields.merge_small(labels, 5).ravel())[1:].min() >= 5
    image = np.zeros((20, 30, 3))
    image[:, 15:] = 80
    found = fields.superpixels(image, 10)
    assert found.shape == (20, 30) and 4 <= found.max() + 1 <= 8
    assert not set(found[:, :15].ravel()) & set(found[:, 15:].ravel())
    assert (fields.regions(found) == found).all()


def test_tree_filter_and_nearest(spark):
    rng = np.random.default_rng(1)
    rows = []
    for tree, n in ((1, 40), (2, 1), (3, 25)):
        parent = [None] + [int(rng.integers(0, i)) for i in range(1, n)]
        rows += [(tree, 10 * i, None if p is None else 10 * p, float(rng.uniform(0.1, 2)), float(rng.normal())) for i, p in enumerate(parent)]
    found = {(r["tree"], r["node"]): r["value"] for r in fields.by_tree(spark.createDataFrame(rows, "tree int, node long, parent long, length double, value double"), "tree", lambda p, d, v: fields.tree_filter(p, d, v, 0.7)).collect()}
    for tree in (1, 2, 3):
        mine = [r for r in rows if r[0] == tree]
        edges = {}
        for _, a, b, d, _ in mine:
            if b is not None:
                edges.setdefault(a, []).append((b, d))
                edges.setdefault(b, []).append((a, d))
        ways = {}
        for _, start, *_ in mine:
            far, todo = {start: 0.0}, [(0.0, start)]
            while todo:
                d, a = heapq.heappop(todo)
                for b, e in edges.get(a, []):
                    if b not in far:
                        far[b] = d + e
                        heapq.heappush(todo, (d + e, b))
            ways[start] = far
            assert found[tree, start] == pytest.approx(sum(r[4] * np.exp(-far[r[1]] / 0.7) for r in mine))
        parent = np.asarray([-1 if r[2] is None else r[2] // 10 for r in mine])
        marked = np.arange(len(mine)) % 7 == 3
        far, best = fields.tree_nearest(parent, np.asarray([r[3] for r in mine]), marked)
        for i in range(len(mine)):
            want = min(((ways[10 * i][10 * m], m) for m in np.flatnonzero(marked)), default=(np.inf, -1))
            assert far[i] == pytest.approx(want[0]) and best[i] == want[1]
    with pytest.raises(ValueError, match="cycle"):
        fields.levels(np.asarray([-1, 2, 1]))


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("channels", [1, 3])
def test_sequence_files(spark, tmp_path, compressed, channels):
    rng = np.random.default_rng(2)
    frames = [(1000 + i / 25, rng.integers(0, 256, (5, 7, channels)).astype(np.uint8)) for i in range(6)]
    data = sequences.sequence(frames, 10.0, compressed, "some words")
    (tmp_path / "a.seq").write_bytes(data)
    (tmp_path / "b.seq").write_bytes(sequences.with_header(data, descr="other"))
    (tmp_path / "c.seq").write_bytes(b"no sequence")
    heads = {r["file"].rsplit("/", 1)[1]: r for r in sequences.read_headers(spark, str(tmp_path)).collect()}
    assert set(heads) == {"a.seq", "b.seq"} and heads["a.seq"]["descr"] == "some words" and heads["b.seq"]["descr"] == "other"
    assert heads["a.seq"]["frames"] == 6 and heads["a.seq"]["fps"] == pytest.approx(25) and (heads["a.seq"]["width"], heads["a.seq"]["height"]) == (7, 5)
    read = sequences.read_frames(spark, f"{tmp_path}/a.seq")
    rows = read.orderBy("frame").collect()
    assert [r["ts"] for r in rows] == pytest.approx([t for t, _ in frames])
    assert all((np.asarray(r["data"]).reshape(5, 7, channels) == i).all() for r, (_, i) in zip(rows, frames, strict=True))
    again = sequences.sequence_bytes(sequences.crop_frames(read, 2, 4), "file", 25.0, compressed).first()["content"]
    assert again == sequences.sequence(frames[2:5], 25.0, compressed)
    both = sequences.dual(read, sequences.crop_frames(read, 4, 5)).orderBy("frame").collect()
    assert [(r["frame"], r["ts_a"], r["ts_b"]) for r in both] == [(0, rows[0]["ts"], rows[4]["ts"]), (1, rows[1]["ts"], rows[5]["ts"])]
    assert sequences.read_frames(spark, f"{tmp_path}/a.seq", decoded=False).where("data is not null").count() == 0


def test_order_statistic(spark):
    values = [None, 3.5, -1.0, 3.5, 1e18, 3.5, 0.25, -1e-300, 3.5000000001, -7e200]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    whole = sorted(v for v in values if v is not None)
    assert [statistics.order_statistic(df, "x", k) for k in range(0, 11)] == [None, *whole, None]
    assert statistics.order_statistic(df, "x", 6, bins=2) == whole[5]


def test_curves(spark):
    curve = [(0.9, 0.1), (0.5, 0.2), (0.5, 0.3), (0.2, 0.6), (0.1, 0.6), (0.05, 0.9)]
    df = spark.createDataFrame([("a", i, *p) for i, p in enumerate(curve)], "k string, i int, r double, v double")

    def plain(t):
        d = [*curve, (0.0, 1.0)]
        k = 0
        while k < len(d) - 1 and d[k][0] >= t:
            k += 1
        above, below = d[max(0, k - 1)], d[k]
        s = 0.5 if above[0] == below[0] else (t - below[0]) / (above[0] - below[0])
        return s * above[1] + (1 - s) * below[1]

    targets = [0.01, 0.05, 0.07, 0.1, 0.3, 0.5, 0.8, 0.9, 1.0]
    found = {r["target"]: r["value"] for r in statistics.resample_roc(df, "k", "r", "v", targets).collect()}
    assert found == pytest.approx({t: plain(t) for t in targets})
    kept = statistics.ankles(df, "k", "i", "r", "v").orderBy("i").collect()
    assert [r["i"] for r in kept] == [0, 1, 4, 5]
    assert statistics.spaced(0.01, 1, 3) == pytest.approx([0.01, 0.1, 1])


def test_trimmed_kmeans_and_radial_features(spark):
    rng = np.random.default_rng(4)
    near = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)] + [(100, [90.0, -70.0]), (101, [-50.0, 90.0])], "id long, v array<double>")
    found, centres = cluster.kmeans_trimmed(points, 6, outliers=2 / 62, least=3)
    rows = {r["id"]: r["centre"] for r in found.collect()}
    assert len(rows) == 62 and rows[100] == rows[101] == -1 and sum(c == -1 for c in rows.values()) == 2
    assert not {rows[i] for i in range(30)} & {rows[i] for i in range(30, 60)}
    sizes = [r["n"] for r in centres.orderBy("id").collect()]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == 60
    widths, mean = cluster.radial_width(centres)
    assert min(widths.values()) >= mean / 100
    c = {r["id"]: np.asarray(r["v"]) for r in centres.collect()}
    row = cluster.radial_features(points, centres, widths, constant=True, normalise=True).where("id = 7").first()
    want = np.asarray([np.exp(-((near[7] - c[i]) ** 2).sum() / 2 / widths[i]) for i in sorted(c)] + [1.0])
    assert row["features"] == pytest.approx((want / want.sum()).tolist())
    assert cluster.kmeans_trimmed(points.where("id < 0"), 3)[0].count() == 0


def test_fits(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform(-3, 3, (50, 2))
    want = np.asarray([0.5, -2, 1.5, 3, 0, -4])
    x, y = xy.T
    z = np.stack((x * x, y * y, x * y, x, y, np.ones(50)), 1) @ want
    df = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(xy, z, strict=True)], "x double, y double, z double")
    assert registration.fit_paraboloid(df, "x", "y", "z") == pytest.approx(want, abs=1e-8)
    m = np.asarray([[1.1, -0.2, 30], [0.3, 0.9, -7]])
    rows = []
    for i, p in enumerate(rng.uniform(0, 400, (60, 2))):
        q = m @ [*p, 1]
        rows.append(("k", *map(float, p), *map(float, q if i % 3 else rng.uniform(-900, 900, 2)), float(i % 3 > 0)))
    pairs = spark.createDataFrame([*rows, ("few", 1.0, 2.0, 3.0, 4.0, 1.0)], "key string, x1 double, y1 double, x2 double, y2 double, w double")
    assert registration.fit_affine(pairs.where("key = 'k'"), "w") == pytest.approx(m, abs=1e-6)
    found = {r["key"]: r for r in registration.robust_affine(pairs, "key").collect()}
    assert np.reshape(found["k"]["matrix"], (2, 3)) == pytest.approx(m, abs=0.5) and found["k"]["inliers"] >= 40 and found["few"]["matrix"] is None
    g = pairs.where("key = 'k'").agg(*(c.alias(n) for c, n in zip(registration.pair_gauss_gradient([F.col("x1"), F.col("y1")], [F.col("x2"), F.col("y2")], 50.0), "ab", strict=True))).first()
    d = np.asarray([[r[1] - r[3], r[2] - r[4]] for r in rows])
    assert [g["a"], g["b"]] == pytest.approx(((np.exp(-(d**2).sum(1) / 2500)[:, None] * d).sum(0) / 2500).tolist())
