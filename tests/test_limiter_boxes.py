"""The limiter on giant callers and on streams, and boxes by grids, against plain folds and all pairs."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from docquill.operators import boxes, limiter, segments
from docquill.plans.order import requests
from docquill.streaming.windows import admit_stream


def fold(rows, limit=50, seconds=3600):
    out, admitted = {}, {}
    for caller, i, t, n in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        held = [(a, b) for a, b in admitted.get(caller, []) if a >= t - seconds]
        ok = sum(b for _, b in held) + n <= limit
        out[i] = (ok, 0 if ok or not held else max(0, held[0][0] + seconds - t))
        admitted[caller] = [*held, (t, n)] if ok else held
    return out


def answers(df):
    return {r.id: (r.admitted, r.retry_after) for r in df.collect()}


KINDS = "caller string, id long, t long, n long"


def asked(n=600, callers=("a", "b"), step=400):
    rng, t, rows = random.Random(n), 0, []
    for i in range(n):
        t += rng.choice([0, 1, rng.randrange(step), rng.randrange(20 * step) if i % 50 == 0 else 3])
        rows.append((rng.choice(callers), i, t, rng.randint(1, 20)))
    return rows


@pytest.mark.parametrize("bits,warm", [(3, 0), (3, 8), (5, 16), (6, 64)])
def test_segments_of_a_caller_meet(spark, bits, warm):
    """Without any requests to start on, segments are run again until they meet."""
    rows = [*asked(), *[("c", 1000 + i, i, 1) for i in range(5)]]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    big = segments.giants(df, ["caller"], 100)
    assert answers(limiter.admit(df, big=big, bits=bits, warm=warm)) == fold(rows)


def test_one_caller_with_all_events(spark):
    df = requests(spark, "/root/testdata/sf0.01").withColumn("caller", F.lit("x"))
    big = segments.giants(df, ["caller"], 1000)
    got = limiter.admit(df, big=big, bits=11)
    assert answers(got) == fold([tuple(r) for r in df.select("caller", "id", "t", "n").collect()])
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("seconds", [1, 50, 3600])
def test_demand(spark, seconds):
    rows = asked(300)
    got = {r.id: r.asked for r in limiter.demand(spark.createDataFrame(rows, KINDS), seconds).collect()}
    assert got == {i: sum(m for d, _, u, m in rows if d == c and t - seconds <= u <= t) for c, i, t, _ in rows}


def test_state_of_a_stream_expires(spark, tmp_path):
    first, later = [("a", 1, 1000, 30), ("a", 2, 1010, 30), ("b", 3, 1020, 40)], [("c", 4, 20_000, 1)]
    (tmp_path / "in").mkdir()
    s = admit_stream(spark.readStream.schema(KINDS).parquet(str(tmp_path / "in")), late="1 second")
    q = s.writeStream.outputMode("append").format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        kept = []
        for rows in (first, later, [("c", 5, 20_001, 50)]):
            spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
            time.sleep(1)
            kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        q.stop()
    assert {r.id: r.admitted for r in spark.table("admitted").collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    assert kept[0] == 2 and kept[-1] == 1  # callers a and b are gone


BOX = "doc_id long, page long, seq long, box array<double>"


def some_boxes(n, seed, wide=40.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(-50, 200), rng.uniform(0, 200)
        w, h = rng.choice([0.4, 5, wide, 300]) * rng.random(), rng.choice([0.4, 5, wide]) * rng.random()
        out.append((rng.choice([1, 1, 1, 2, None]), rng.choice([1, 1, 2]), i, [x, y, x + w, y + h]))
    out += [(d, p, n + i, [v + rng.uniform(-0.9, 0.9) for v in b]) for i, (d, p, _, b) in enumerate(out[: n // 4])]
    return [*out, (1, 1, 5000, None), (1, 1, 5001, [1.0, 2.0]), (1, 1, 5002, [5.0, 5.0, 5.0, 9.0])]


@pytest.mark.parametrize("n", [1, 60, 250])
def test_overlapping_pairs(spark, n):
    rows = some_boxes(n, n)
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    fine = [r for r in rows if r[3] is not None and len(r[3]) == 4 and r[3][2] > r[3][0] and r[3][3] > r[3][1]]
    want = set()
    for d, p, a, u in fine:
        for e, q, b, v in fine:
            if (d, p) == (e, q) and a < b:
                shared = max(0, min(u[2], v[2]) - max(u[0], v[0])) * max(0, min(u[3], v[3]) - max(u[1], v[1])) / min(size(u), size(v))
                same = all(abs(x - y) <= 1 for x, y in zip(u, v))
                if shared > 0 or same:
                    want.add((d, p, a, b, round(shared, 6), same))
    got = [(r.doc_id, r.page, r.a, r.b, round(r.overlap, 6), r.same) for r in boxes.overlapping(spark.createDataFrame(rows, BOX).repartition(3)).collect()]
    assert len(got) == len(want) and set(got) == want


def plain_kept(rows, share=0.8, tolerance=1.0):
    kept = []
    for s, b in rows:
        size = (b[2] - b[0]) * (b[3] - b[1])
        for i, (_, k) in enumerate(kept):
            if all(abs(x - y) <= tolerance for x, y in zip(b, k)):
                break
            w, h = min(b[2], k[2]) - max(b[0], k[0]), min(b[3], k[3]) - max(b[1], k[1])
            old = (k[2] - k[0]) * (k[3] - k[1])
            if w > 0 and h > 0 and w * h / min(size, old) >= share:
                if size > old:
                    kept[i] = (s, b)
                break
        else:
            kept.append((s, b))
    return kept


@pytest.mark.parametrize("seed", range(5))
def test_a_box_meets_its_neighbours_only(seed):
    rows = [(s, b) for _, _, s, b in some_boxes(700, seed, 12.0) if b and len(b) == 4 and b[2] > b[0] and b[3] > b[1]]
    kept = boxes._Kept(0.8, 1.0)
    for s, b in rows:
        kept.offer(s, b)
    assert kept.boxes == plain_kept(rows)


def test_many_boxes_of_one_page():
    rng, kept, began = random.Random(1), boxes._Kept(0.8, 1.0), time.time()
    for i in range(100_000):
        x, y = rng.uniform(0, 30_000), rng.uniform(0, 30_000)
        kept.offer(i, [x, y, x + rng.uniform(1, 60), y + rng.uniform(1, 60)])
    assert len(kept.boxes) > 90_000 and time.time() - began < 30


def test_infinite_corners_go(spark):
    rows = [(1, 1, 0, [0.0, 0.0, math.inf, 5.0]), (1, 1, 1, [0.0, 0.0, 3.0, 5.0]), (1, 1, 2, [math.nan, 0.0, 3.0, 5.0])]
    assert [r.seq for r in boxes.drop_repeated_boxes(spark.createDataFrame(rows, BOX)).collect()] == [1]


def test_all_pairs_of_a_page(spark):
    """Boxes that are far apart are a pair too, with nothing shared."""
    rows = [(1, 1, 0, [0.0, 0.0, 2.0, 2.0]), (1, 1, 1, [1.0, 0.0, 3.0, 2.0]), (1, 1, 2, [90.0, 90.0, 91.0, 91.0]), (1, 2, 3, [0.0, 0.0, 2.0, 2.0]), (2, 1, 4, [0.0, 0.0, 2.0, 2.0])]
    got = sorted((r.doc_id, r.page, r.a, r.b, r.overlap, r.same) for r in boxes.page_pairs(spark.createDataFrame(rows, BOX)).collect())
    assert got == [(1, 1, 0, 1, 0.5, True), (1, 1, 0, 2, 0.0, False), (1, 1, 1, 2, 0.0, False)]
