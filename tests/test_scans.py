"""Block-wise running values against plain Python, with blocks of a few rows so that borders matter."""

import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators import frames, joins, scans
from cuemill.operators.frames import speech_regions
from cuemill.operators.segments import floor_durations


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_ROWS", 4)


def table(spark, seed, n=60, gaps=True):
    rnd = random.Random(seed)
    rows = []
    for k in (1, 2):
        pos = -1
        for _ in range(n if k == 1 else 5):
            pos += rnd.choice([1, 1, 1, 6, 13]) if gaps else 1
            rows.append((k, pos, rnd.choice([None, *range(9)])))
    return spark.createDataFrame(rows, "k int, pos long, v int"), sorted(rows, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed", range(3))
def test_scan_equals_loop(spark, seed):
    df, rows = table(spark, seed)
    got = scans.scan(
        df, "k", "pos", None, s=scans.sum_before("v"), m=scans.max_upto("v"), mb=scans.max_before("v"), lag=scans.lag("v"), lead=scans.lead("v"), last=scans.last_upto("v"),
        lb=scans.last_before("v"), nxt=scans.next_after("v"), nf=scans.next_from("v"))
    got = {(r.k, r.pos): r for r in got.collect()}
    assert len(got) == len(rows)
    for k in (1, 2):
        mine = [r for r in rows if r[0] == k]
        vs = [r[2] for r in mine]
        known = lambda xs: [x for x in xs if x is not None]
        for i, (_, pos, v) in enumerate(mine):
            r = got[(k, pos)]
            before, upto, after = known(vs[:i]), known(vs[: i + 1]), known(vs[i + 1:])
            assert r.s == sum(before)
            assert r.m == (max(upto) if upto else None)
            assert r.mb == (max(before) if before else None)
            assert r.lag == (vs[i - 1] if i else None)
            assert r.lead == (vs[i + 1] if i + 1 < len(vs) else None)
            assert r.last == (upto[-1] if upto else None)
            assert r.lb == (before[-1] if before else None)
            assert r.nxt == (after[0] if after else None)
            assert r.nf == (v if v is not None else after[0] if after else None)


@pytest.mark.parametrize("seed", range(3))
def test_runs_and_change_runs(spark, seed):
    df, rows = table(spark, seed)
    got = {(r.k, r.pos): r.run_no for r in scans.runs(df, "k", "pos", F.col("v") > 3).collect()}
    ch = {(r.k, r.pos): r.run_no for r in scans.change_runs(df, "k", "pos", None, ["v"], lambda c, p: c("v").eqNullSafe(p("v"))).collect()}
    for k in (1, 2):
        n, on, c, prev = 0, False, 0, object()
        for _, pos, v in (r for r in rows if r[0] == k):
            keep = v is not None and v > 3
            n += keep and not on
            on = keep
            assert got.get((k, pos)) == (n if keep else None)
            c += v != prev
            prev = v
            assert ch[(k, pos)] == c


@pytest.mark.parametrize("seed", range(4))
def test_floor_durations_recurrence(spark, seed):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(40):
        t += rnd.randint(-15, 40)
        rows.append((1, i * 3, t, t + rnd.randint(-10, 50)))
    limit = rnd.choice([None, 500])
    df = spark.createDataFrame(rows, "k int, pos long, a long, b long")
    out = floor_durations(df, "k", "pos", F.col("a"), F.col("b"), F.lit(7).cast("long"), None if limit is None else F.lit(limit).cast("long"))
    got = {r.pos: (r.output_word_start, r.output_word_end) for r in out.collect()}
    prev = 7
    for _, pos, a, b in rows:
        s = max(prev, a)
        e = max(s + 20, b)
        e = e if limit is None else min(limit, e)
        assert got[pos] == (s, e)
        prev = e


def test_previous_at_any_positions(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_ROWS", 8)
    for at in (list(range(20)), [3, 7, 8, 9, 40, 41, 64, 200], [1000]):
        df = spark.createDataFrame([(1, p) for p in at], "k int, pos long")
        got = {r.pos: r.p for r in scans.previous(df, "k", "pos", p="pos").collect()}
        assert got == dict(zip(at, [None, *at]))


def test_neighbours_cross_empty_and_short_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_ROWS", 8)
    at = [0, 7, 8, 23, 24, 25, 90, 100, 101, 102, 103, 104, 105, 106, 300]
    df = spark.createDataFrame([(k, p) for k in (1, 2) for p in at], "k int, pos long")
    for r in scans.neighbours(df, "k", "pos", ["pos"], back=3, ahead=2).collect():
        i = at.index(r.pos)
        assert [x.pos for x in r["__before"]] == at[max(0, i - 3) : i] and [x.pos for x in r["__after"]] == at[i + 1 : i + 3]


def test_frame_rules_do_not_depend_on_the_offset(spark, monkeypatch):
    """The same gapped series gives the same answer wherever it lies against the blocks."""
    monkeypatch.setattr(scans, "BLOCK_ROWS", 8)
    gaps = [0, 1, 2, 4, 5, 6, 7, 11, 12, 13, 14, 15, 16, 30, 31, 32]
    v = [-5, 5, 6, -1, 0, 3, 4, -4, -2, 2, 2, -1, -1, 9, -9, 1]
    flag = [x > 0 for x in v]
    seen = {"cross": set(), "smooth": set()}
    for off in range(9):
        samples = spark.createDataFrame([("m", off + i, x, f) for i, x, f in zip(gaps, v, flag)], "media_id string, i long, v int, active boolean")
        seen["cross"].add(tuple(sorted(r.i - off for r in frames.zero_crossings(samples).collect())))
        smoothed = frames.smooth(samples.withColumnRenamed("i", "frame")).collect()
        seen["smooth"].add(tuple(r.smoothed for r in sorted(smoothed, key=lambda r: r.frame)))
    assert len(seen["cross"]) == len(seen["smooth"]) == 1
    assert 1 in next(iter(seen["cross"]))


@pytest.mark.parametrize("seed", range(3))
def test_hysteresis_model(spark, seed):
    rnd = random.Random(seed)
    vs = [rnd.choice([0.1, 0.2, 0.3, 0.4, 0.45, 0.6, 0.9]) for _ in range(70)]
    run = 1 + seed
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vs)], "media_id int, frame long, p_speech double")
    got = sorted((r.start_frame, r.end_frame, r.peak, r.closed) for r in speech_regions(df, run=run).collect())
    want, on, start, below, peak = [], False, 0, None, 0
    for i, p in enumerate(vs):
        if not on:
            if p >= 0.5:
                on, start, below, peak = True, i, None, p
            continue
        peak = max(peak, p)
        if p < 0.35:
            below = i if below is None else below
            if i - below + 1 >= run:
                want.append((start, below, peak, True))
                on = False
        else:
            below = None
    if on:
        want.append((start, len(vs), peak, False))
    assert got == want


def test_nearest_prefers_the_first_listed(spark):
    rnd = random.Random(5)
    facts = [(1, rnd.randint(0, 200), i) for i in range(30)]
    points = [(1, t, t) for t in range(0, 210, 3)]
    f = spark.createDataFrame(facts, "k int, t long, i long")
    p = spark.createDataFrame(points, "k int, at long, pid long")
    got = {r.pid: r.nearest.i for r in joins.nearest(p, f, "k", "at", "t", "i", 16, "pid").collect()}
    for _, at, pid in points:
        assert got[pid] == min(facts, key=lambda x: (abs(x[1] - at), x[2]))[2]


def test_range_join_has_no_repeats(spark):
    ranges = spark.createDataFrame([(1, 0, 95, "a"), (1, 10, 12, "b"), (2, 0, 5, "c")], "k int, lo long, hi long, n string")
    points = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    j = joins.bucketed_range_join(points, ranges, "k", F.col("x"), F.col("lo"), F.col("hi"), (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")), 10)
    assert sorted((r.x, r.n) for r in j.collect()) == sorted([(x, "a") for x in range(96)] + [(x, "b") for x in (10, 11, 12)])
