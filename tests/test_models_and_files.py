"""Kernels, fits and files against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselq.operators import images, learning
from tesselq.sources import png


def test_convolution_and_adjoint():
    rng = np.random.default_rng(0)
    a, k = rng.normal(size=(9, 11, 2)), rng.normal(size=(3, 5))
    padded = np.pad(a, ((1, 1), (2, 2), (0, 0)))
    want = sum(k[2 - i, 4 - j] * padded[i : i + 9, j : j + 11] for i in range(3) for j in range(5))
    assert images.convolve(a, k) == pytest.approx(want)
    b, row = rng.normal(size=(9, 11)), rng.normal(size=5)
    assert (images.separable(a[:, :, 0], row) * b).sum() == pytest.approx((a[:, :, 0] * images.separable_adjoint(b, row)).sum())


def test_kernels():
    assert images.gaussian_kernel((1, 2), 6).sum() == pytest.approx(1) and images.binomial_kernel(2)[2].tolist() == pytest.approx([6 / 256, 24 / 256, 36 / 256, 24 / 256, 6 / 256])
    assert images.dog_kernel(1, 1.6, 8).sum() == pytest.approx(0) and images.gabor_kernel(2, 5, 30, 0.3, 8).sum() == pytest.approx(0, abs=1e-9)
    ramp = np.outer(np.ones(41), np.arange(41.0))
    assert images.convolve(ramp, images.derivative_kernel(1.5, (0, 1), 8))[20, 20] == pytest.approx(1, abs=1e-3)
    assert images.filter_bank(ramp[:, :, None], [images.binomial_kernel(1)] * 3).shape == (41, 41, 3)
    assert images.centre_symmetric_census(ramp[:, :, None])[20, 20] == 4 and images.ellipse_mask(5, 5, 2, 2, 2, 1).sum() == 7


@pytest.mark.parametrize("flow", [images.lucas_kanade, images.horn_schunck])
def test_flow_of_a_shift(flow):
    y, x = np.mgrid[:48, :48] / 48
    at = lambda dx, dy: np.sin(9 * (x - dx / 48)) + np.cos(7 * (y - dy / 48)) + np.sin(5 * (x + y - (dx + dy) / 48))
    uv = flow(at(0, 0), at(0.4, -0.3))[10:-10, 10:-10]
    assert np.median(uv[:, :, 0]) == pytest.approx(0.4, abs=0.08) and np.median(uv[:, :, 1]) == pytest.approx(-0.3, abs=0.08)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_round_trip(channels, kind):
    image = np.random.default_rng(channels).integers(0, np.iinfo(kind).max, (7, 5, channels)).astype(kind)
    assert (png.decode(png.encode(image)) == image).all()
    assert png.decode(b"none") is None and png.decode(png.encode(image)[:60]) is None


def test_png_filters():
    """Rows filtered by hand, one of each kind."""
    import struct
    import zlib

    image = np.random.default_rng(3).integers(0, 255, (5, 6, 3)).astype(np.int32)
    rows = []
    for y in range(5):
        up = image[y - 1] if y else np.zeros((6, 3), int)
        left, corner = np.pad(image[y], ((1, 0), (0, 0)))[:-1], np.pad(up, ((1, 0), (0, 0)))[:-1]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        guess = (0, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner)))[y]
        rows.append(bytes([y]) + ((image[y] - guess) & 255).astype(np.uint8).tobytes())
    whole = png.encode(image.astype(np.uint8))
    body = zlib.compress(b"".join(rows))
    at = whole.index(b"IDAT") - 4
    assert (png.decode(whole[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + b"0000" + whole[-12:]) == image).all()


def test_image_files(spark, tmp_path):
    rows = [(1, 3, 2, 1, [0.0, 1.0, 2.4, 300.0, -5.0, 9.6]), (2, 1, 1, 3, None)]
    out = {r["id"]: r["content"] for r in png.image_bytes(spark.createDataFrame(rows, "id long, w int, h int, channels int, data array<float>")).collect()}
    (tmp_path / "a.png").write_bytes(out[1])
    (tmp_path / "b.png").write_bytes(b"broken")
    back = {r["file"][-5:]: r["data"] for r in png.read_images(spark, str(tmp_path)).collect()}
    assert out[2] is None and back == {"a.png": [0, 1, 2, 255, 0, 10], "b.png": None}


def test_flow_images(spark, tmp_path):
    u, v = np.asarray([[1.5, np.nan], [-3.25, 0.0]]), np.asarray([[0.25, 1.0], [7.0, -0.5]])
    (tmp_path / "f.png").write_bytes(png.flow_image(u, v))
    got = {(r["x"], r["y"]): (r["u"], r["v"]) for r in png.read_flow_images(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (1.5, 0.25), (1, 0): (None, None), (0, 1): (-3.25, 7.0), (1, 1): (0.0, -0.5)}


def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal([0, 0, 0], [3, 1, 0.2], (120, 3)), rng.normal([4, 4, 1], [3, 1, 0.2], (80, 3))))
    return x, spark.createDataFrame([(i, v.tolist(), int(i >= 120)) for i, v in enumerate(x)], "id long, v array<double>, label int")


def test_principal_axes(spark):
    x, df = points(spark)
    mean, axes, variances = learning.principal_axes(df, "v", 3, 2)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert mean == pytest.approx(x.mean(0)) and variances == pytest.approx(values[::-1][:2])
    assert abs(np.asarray(axes) @ vectors[:, ::-1][:, :2]) == pytest.approx(np.eye(2), abs=1e-6)
    got = [r[0] for r in df.orderBy("id").select(learning.project(F.col("v"), mean, axes)).collect()]
    assert np.asarray(got) == pytest.approx((x - x.mean(0)) @ np.asarray(axes).T)
    assert learning.scatter(df.limit(0), "v", 3)[0] == 0


def test_discriminant_in_folds(spark):
    x, df = points(spark)
    apply = lambda part, model: part.select("id", "label", learning.discriminate(F.col("v"), model).alias("predicted"))
    out = learning.folds(df, "id", 3, lambda part: learning.discriminant(part, "v", "label", 3), apply).collect()
    assert sorted(r["id"] for r in out) == list(range(200)) and {r["fold"] for r in out} == {0, 1, 2}
    assert np.mean([r["predicted"] == r["label"] for r in out]) > 0.95


def test_trees_and_null_features(spark):
    tree = {"feature": "a", "below": 1, "left": {"value": 2}, "right": {"value": 3}}
    df = spark.createDataFrame([(0.0,), (1.0,), (None,)], "a double")
    assert [r[0] for r in df.select(learning.boosted([tree, tree], {"a": F.col("a")})).collect()] == [4.0, 6.0, 6.0]


def test_timeline_edits(spark):
    from tesselq.operators import annotations

    t = spark.createDataFrame([(1, 0, 4, "a"), (1, 5, 9, "b"), (1, 10, 14, "c"), (2, 0, 3, "a")], "k long, first int, last int, label string")
    spans = lambda df, k=1: sorted((r["first"], r["last"], r["label"]) for r in df.where(f"k = {k}").collect())
    assert spans(annotations.insert_interval(t, ["k"], "first", "last", "label", 3, 6, "n")) == [(0, 2, "a"), (3, 6, "n"), (7, 9, "b"), (10, 14, "c")]
    assert spans(annotations.insert_interval(t, ["k"], "first", "last", "label", 6, 7, "n")) == [(0, 4, "a"), (5, 5, "b"), (6, 7, "n"), (8, 9, "b"), (10, 14, "c")]
    assert spans(annotations.move_border(t, ["k"], "first", "last", 5, 8)) == [(0, 7, "a"), (8, 9, "b"), (10, 14, "c")]
    assert spans(annotations.move_border(t, ["k"], "first", "last", 5, -9)) == [(0, 0, "a"), (1, 9, "b"), (10, 14, "c")]
    assert spans(annotations.move_border(t, ["k"], "first", "last", 5, 99)) == [(0, 8, "a"), (9, 9, "b"), (10, 14, "c")]
    assert spans(annotations.relabel(t, "label", {"a": "z"}), 2) == [(0, 3, "z")]
    assert spans(annotations.merge_timelines([t, t.where("k = 2"), t], ["k"], "first", "last"), 2) == [(0, 3, "a"), (4, 7, "a"), (8, 11, "a")]


def test_box_files_listing_and_matrices(spark, tmp_path):
    from tesselq.sources import text_tables

    names = ("x", "y", "w", "h", "occluded", "bx", "by", "bw", "bh", "ignore", "angle")
    rows = [(7, "cat", 1.4, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 10.0), (8, "dog", 5.0, 6.0, 7.0, 8.0, 1.0, 1.0, 1.0, 2.0, 2.0, 0.0, 0.0)]
    text_tables.write_boxes(spark.createDataFrame(rows, "img long, label string, " + ", ".join(f"{n} double" for n in names)), f"{tmp_path}/boxes")
    back = {r["label"]: tuple(r[n] for n in names) for r in text_tables.read_boxes(spark, f"{tmp_path}/boxes/*/*.txt").collect()}
    assert back == {"cat": (1, *rows[0][3:]), "dog": rows[1][2:]}
    for d, n in (("a", "one.txt"), ("a", "two.txt"), ("b", "one.png"), ("b", "three.png")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_text("1 2\n\n3,x\n")
    pairs = {r["name"]: (r["a"] is not None, r["b"] is not None) for r in text_tables.paired_files(spark, f"{tmp_path}/a", f"{tmp_path}/b", (".txt", ".png")).collect()}
    assert pairs == {"one": (True, True), "two": (True, False), "three": (False, True)}
    assert [(r["row"], r["values"]) for r in text_tables.read_matrix(spark, f"{tmp_path}/a/one.txt").orderBy("row").collect()] == [(0, [1.0, 2.0]), (1, [3.0, None])]
