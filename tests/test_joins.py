"""Range joins by cells, sweeps and rows beside rows, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuemill.operators import joins


@pytest.mark.parametrize("seed,long_ranges", [(0, False), (1, True), (2, True)])
def test_range_join_equals_all_pairs(spark, seed, long_ranges):
    rng = random.Random(seed)
    # One item holds nine of ten points; ranges are from empty to the whole item.
    points = [(0 if rng.random() < 0.9 else rng.randint(1, 4), i, rng.randint(-50, 100_000)) for i in range(1500)]
    ranges = []
    for i in range(60):
        lo = rng.randint(-100, 100_000)
        ranges.append((rng.randint(0, 4), i, lo, lo + rng.choice([-1, 0, 3, 900, 20_000, 150_000])))
    p, r = spark.createDataFrame(points, "media_id long, point long, at long"), spark.createDataFrame(ranges, "media_id long, range long, lo long, hi long")
    inside = (F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi"))
    got = joins.bucketed_range_join(p, r, "media_id", F.col("at"), F.col("lo"), F.col("hi"), inside, 100, long_ranges=long_ranges)
    assert got.columns == ["media_id", "point", "at", "range", "lo", "hi"]
    assert Counter((x.point, x.range) for x in got.collect()) == Counter((i, j) for m, i, at in points for n, j, lo, hi in ranges if m == n and lo <= at <= hi)


def test_no_ranges_and_no_points(spark):
    p, r = spark.createDataFrame([(1, 5)], "media_id long, at long"), spark.createDataFrame([(1, 0, 9)], "media_id long, lo long, hi long")
    for a, b in ((p, r.where("false")), (p.where("false"), r)):
        assert joins.bucketed_range_join(a, b, "media_id", F.col("at"), F.col("lo"), F.col("hi"), F.col("at") >= F.col("lo"), 10, long_ranges=True).count() == 0


def test_a_range_has_few_cells_and_covers_its_buckets_once(spark):
    rng = random.Random(1)
    rows = [(a, a + n) for a, n in [(0, 0), (0, 1 << 30), (5, 1 << 29), (-7, 20)] + [(rng.randint(-9, 99), rng.randint(0, 300)) for _ in range(200)]]
    df = spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", joins.range_cells(F.col("lo"), F.col("hi"), 1).alias("cells"))
    for x in df.collect():
        assert len(x.cells) < 64
        spans = sorted((c.place << c.level, (c.place + 1) << c.level) for c in x.cells)
        assert spans[0][0] == x.lo and spans[-1][1] == x.hi + 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_rows_beside_rows(spark):
    rng = random.Random(2)
    rows = [(m, i, rng.choice([None, rng.randint(0, 9)]), "x") for m in range(3) for i in range(1, 30)]
    df = joins.beside_rows(spark.createDataFrame(rows, "k long, n long, v int, own string"), "k", "n", nxt=("v", 1), prev=("v", -1), far=("v", 3))
    at = {(m, i): v for m, i, v, _ in rows}
    assert Counter(map(tuple, df.collect())) == Counter((m, i, v, o, at.get((m, i + 1)), at.get((m, i - 1)), at.get((m, i + 3))) for m, i, v, o in rows)


def test_sweep_finds_the_nearest_facts_of_every_kind(spark):
    rng = random.Random(3)
    rows = []
    for m in range(3):
        for n in range(1, 40):
            lo = rng.randint(-30, 500)
            hi = lo + rng.choice([-3, 0, 5, 40, 260])
            rows.append((m, n, rng.randint(lo - 5, max(lo, hi) + 5), lo, hi, rng.random() < 0.7))
    one = sorted({(m, rng.randint(0, 500)) for m in range(3) for _ in range(60)})
    two = sorted({(m, rng.randint(0, 500)) for m in range(3) for _ in range(15)})
    r = spark.createDataFrame(rows, "media long, no long, at long, lo long, hi long, asks boolean")
    facts = {"one": (spark.createDataFrame([(m, a, a * 2) for m, a in one], "media long, at long, twice long"), 16), "two": (spark.createDataFrame(two, "media long, at long"), 64)}
    got = joins.sweep(r, "media", "no", {"one": (F.lit(True), F.col("at"), F.col("lo"), F.col("hi")), "two": (F.col("asks"), F.col("at"), F.col("lo"), F.col("hi"))}, facts)
    want = {}
    for m, n, at, lo, hi, asks in rows:
        near, at = [], min(hi, max(lo, at))
        for have, on in ((one, True), (two, asks)):
            near += [max((a for k, a in have if on and k == m and lo <= a <= hi and a <= at), default=None), min((a for k, a in have if on and k == m and lo <= a <= hi and a >= at), default=None)]
        want[m, n] = near
    found = got.collect()
    assert len(found) == len(rows)
    for x in found:
        assert [f and f.at for f in (x.one_before, x.one_after, x.two_before, x.two_after)] == want[x.media, x.no]
        assert all(f is None or f.twice == 2 * f.at for f in (x.one_before, x.one_after))


def test_nearer_prefers_the_earlier(spark):
    side = "struct<at:long>"
    df = spark.createDataFrame([((3,), (5,)), (None, (5,)), ((3,), None), ((1,), (5,))], f"k_before {side}, k_after {side}")
    assert [x[0] and x[0].at for x in df.select(joins.nearer("k", F.lit(4))).collect()] == [3, 5, 3, 5]


def test_sweep_over_ranges_is_a_sweep_over_their_places(spark):
    rnd = random.Random(11)
    step, width, ranges, places = 3, 60, [], []
    for media in range(3):
        at = 0
        while at < 600:
            at += rnd.randrange(3, 30, 3)
            to = min(at + 3 * rnd.randint(0, 8), at // width * width + width - step)
            ranges.append((media, at, to))
            places += [(media, x) for x in range(at, to + 1, step)]
            at = to
    asks = [(m, n, rnd.randint(0, 620), lo, lo + rnd.randint(0, 70)) for m in range(3) for n, lo in enumerate(rnd.choices(range(600), k=120))]
    rows = spark.createDataFrame(asks, "media long, no long, at long, lo long, hi long")
    ask = {"one": (F.lit(True), F.col("at"), F.col("lo"), F.col("hi"))}
    a = joins.sweep(rows, "media", "no", ask, {"one": (spark.createDataFrame(places, "media long, at long"), width)})
    b = joins.sweep(rows, "media", "no", ask, {"one": (spark.createDataFrame(ranges, "media long, at long, to long"), width)}, {"one": step})
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
