"""Operators on small fixtures with known results."""

import random

import pytest

from tesselq.functions import boxes, colour, distance
from tesselq.operators import graph, nearest, overlap, statistics
from tesselq.sources import text_tables
from tesselq.streaming import timelines


def test_spanning_tree(spark):
    e = [(0, 1, .04), (1, 2, .08), (2, 3, .07), (3, 4, .09), (4, 5, .10), (5, 6, .02), (6, 7, .01), (7, 0, .08), (7, 1, .11), (7, 8, .07), (8, 6, .06), (8, 2, .02), (3, 5, .14), (2, 5, .04)]
    rows = graph.spanning_forest(spark.createDataFrame(e, "src int, dst int, w double")).collect()
    assert len(rows) == 8 and sum(r["w"] for r in rows) == pytest.approx(0.37)


def test_shortest_paths(spark):
    e = [(0, 1, 1), (2, 0, 10), (0, 3, 2), (3, 0, 3), (3, 1, 9), (1, 4, 4), (4, 1, 6), (2, 3, 5), (4, 2, 7), (3, 4, 2)]
    rows = graph.shortest_paths(spark.createDataFrame([(a, b, float(w)) for a, b, w in e], "src int, dst int, w double"), 2).collect()
    assert {r["node"]: r["dist"] for r in rows} == {0: 8, 1: 9, 2: 0, 3: 5, 4: 7}


def test_suppression(spark):
    rows = [(1, 1, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 2, 0.1, 0.1, 1.0, 1.0, 1.1), (1, 3, 2.0, 2.0, 1.0, 1.0, 1.0)]
    b = spark.createDataFrame(rows, "img long, id long, x double, y double, w double, h double, score double")
    for run in (overlap.suppress, overlap.suppress_greedy):
        assert sorted(r["id"] for r in run(b, "img", 0.5).collect()) == [2, 3]
    hits = overlap.evaluate(b, b.where("id <> 1"), "img").collect()
    assert {r["id"]: r["match"] for r in hits if not r["is_truth"]} == {1: 0, 2: 1, 3: 1}


def random_boxes(n, images=4):
    rng = random.Random(n)
    return [(rng.randrange(images), i, *(float(rng.randrange(12)) for _ in range(2)), *(float(rng.randrange(0, 9)) for _ in range(2)), float(rng.randrange(6))) for i in range(n)]


def share(a, b, own=False):
    common = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    of = a[4] * a[5] if own else a[4] * a[5] + b[4] * b[5] - common
    return common / of if common else 0.0


SCHEMA = "img long, id long, x double, y double, w double, h double, score double"


def test_greedy_suppressions_against_plain_loops(spark):
    rows = random_boxes(90)
    kept, covered = set(), {}
    for img in range(4):
        for r in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[6], r[1])):
            if all(share(r, k) <= 0.3 for k in rows if k[1] in kept and k[0] == img):
                kept.add(r[1])
        free = [r for r in rows if r[0] == img]
        while free:
            around = lambda r: [o for o in free if o is r or share(r, o) > 0.3]
            best = max(free, key=lambda r: (sum(o[6] for o in around(r)), -r[1]))
            covered[best[1]] = sum(o[6] for o in around(best))
            gone = {o[1] for o in around(best)}
            free = [o for o in free if o[1] not in gone]
    b = spark.createDataFrame(rows, SCHEMA)
    assert {r["id"] for r in overlap.suppress_greedy(b, "img", 0.3).collect()} == kept
    assert {r["id"]: r["score"] for r in overlap.suppress_cover(b, "img", 0.3).collect()} == covered
    assert overlap.suppress_greedy(b.limit(0), "img", 0.3).count() == 0


@pytest.mark.parametrize("mul", [False, True])
def test_evaluation_against_a_plain_loop(spark, mul):
    dt, gt = random_boxes(80), [(*r[:6], r[1] % 3 == 0) for r in random_boxes(61)]
    want, taken = {(1, g[1]): -1 if g[6] else 0 for g in gt}, set()
    for d in sorted(dt, key=lambda r: (-r[6], r[1])):
        own = [g for g in gt if g[0] == d[0]]
        free = [(share(d, g), -g[1]) for g in own if not g[6] and (mul or g[1] not in taken)]
        best = max(free, default=(0, 0))
        want[0, d[1]] = 0
        if best[0] >= 0.3:
            want[0, d[1]] = want[1, -best[1]] = 1
            taken.add(-best[1])
        elif any(share(d, g, own=True) >= 0.3 for g in own if g[6]):
            want[0, d[1]] = -1
    truth = spark.createDataFrame([(*g[:6], int(g[6])) for g in gt], "img long, id long, x double, y double, w double, h double, ignore int")
    found = overlap.evaluate(spark.createDataFrame(dt, SCHEMA), truth, "img", 0.3, mul)
    assert {(r["is_truth"], r["id"]): r["match"] for r in found.collect()} == want and {-1, 0, 1} <= set(want.values())
    last = overlap.evaluation_roc(found).orderBy("score").first()
    assert (last["tp"], last["fp"]) == tuple(sum(v == k for (t, _), v in want.items() if not t) for k in (1, 0))


def test_greedy_suppression_differs_on_chains(spark):
    rows = [(1, i, i * 0.4, 0.0, 1.0, 1.0, 3.0 - i) for i in range(3)]
    b = spark.createDataFrame(rows, "img long, id long, x double, y double, w double, h double, score double")
    assert sorted(r["id"] for r in overlap.suppress(b, "img", 0.4).collect()) == [0]
    assert sorted(r["id"] for r in overlap.suppress_greedy(b, "img", 0.4).collect()) == [0, 2]


def test_overlap_of_pair(spark):
    d = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 0.0, 0.0, 20.0, 20.0)], "ax double, ay double, aw double, ah double, bx double, by double, bw double, bh double")
    from pyspark.sql import functions as F

    a, b = boxes.box("a"), boxes.box("b")
    assert d.select(boxes.iou(a, b), boxes.iou(a, b, F.lit(True))).first()[:] == (0.25, 1.0)


def test_scalars(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    a, b = F.array(*map(F.lit, (1.0, 2.0, 0.0))), F.array(*map(F.lit, (0.0, 2.0, 1.0)))
    row = one.select(distance.l1(a, b), distance.sq_euclidean(a, b), distance.earth_movers(a, b), distance.hamming(F.lit(5), F.lit(6)), colour.to_byte(F.lit(1.7))).first()
    assert row[:] == (2.0, 2.0, 2.0, 2, 255)
    lab = one.select(*colour.rgb_to_lab(F.lit(255), F.lit(255), F.lit(255))).first()
    assert lab[:] == pytest.approx((100, 0, 0), abs=0.01)


def test_nearest_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i // 7)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    whole, blocks = ({(r["id"], r["other"], r["rank"]) for r in nearest.nearest(v, v, 3, block_rows=n).collect()} for n in (1000, 13))
    assert whole == blocks and len(whole) == 180


def test_weighted_median_midpoint(spark):
    d = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 1), ("b", 5.0, 3), ("b", 9.0, 1)], "k string, v double, w int")
    assert {r["k"]: r["median"] for r in statistics.weighted_median(d, ["k"], "v", "w").collect()} == {"a": 2.0, "b": 5.0}


def test_flow_and_match_files(spark, tmp_path):
    flow = spark.createDataFrame([(1, x, y, float(x), None if x == y else float(y)) for x in range(4) for y in range(3)], "img int, x int, y int, u float, v float")
    content = text_tables.flow_bytes(flow, ["img"]).first()["content"]
    (tmp_path / "a.flo").write_bytes(content)
    (tmp_path / "b.flo").write_bytes(b"none")
    back = {(r["x"], r["y"]): (r["u"], r["v"]) for r in text_tables.read_flow(spark, str(tmp_path)).collect()}
    assert len(back) == 12 and back[1, 1] == (None, None) and back[3, 2] == (3.0, 2.0)
    (tmp_path / "m.txt").write_text("1 2 3 4 tail\n\n5 6 7\n")
    rows = text_tables.read_matches(spark, f"{tmp_path}/m.txt").collect()
    assert sorted((r["x1"], r["y2"], r["malformed"]) for r in rows) == [(1.0, 4.0, None), (5.0, None, "5 6 7")]
    text_tables.write_matches(text_tables.read_matches(spark, f"{tmp_path}/m.txt").where("malformed is null"), f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["1 2 3 4"]


def test_streamed_runs(spark, tmp_path):
    for i, part in enumerate([[(1, 0, "a"), (1, 1, "a")], [(1, 2, "a"), (1, 3, "b"), (2, 0, "x")], [(1, 4, "c")]]):
        spark.createDataFrame(part, "k long, i long, label string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k long, i long, label string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = timelines.runs(stream, "k", "i", "label").writeStream.format("memory").queryName("runs_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("runs_out").collect()) == [(1, "a", 0, 2, 3), (1, "b", 3, 3, 1)]
