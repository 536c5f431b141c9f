"""Long series by bucket, windows from running sums, exact quantiles, and combinations that meet in the middle."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions.columns import Axis
from wattloom.operators import blocks, metrics, scans, segments, series

START = dt.datetime(2024, 1, 1)


def at(minute):
    return START + dt.timedelta(minutes=minute)


def test_neighbours_across_buckets(spark):
    rng = random.Random(1)
    rows = [(k % 2, at(rng.randrange(0, 9000)), float(k) if rng.random() < 0.2 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, v double")
    for r in scans.with_neighbours(df, ["k"], "t", "v", scans.HOUR).collect():
        known = [(t, v) for k, t, v in rows if k == r["k"] and v is not None]
        before, after = [t for t, _ in known if t <= r["t"]], [t for t, _ in known if t >= r["t"]]
        assert (r["_before"] in {v for t, v in known if t == max(before)}) if before else r["_before"] is None
        assert (r["_after"] in {v for t, v in known if t == min(after)}) if after else r["_after"] is None


def test_lag_across_buckets(spark):
    rows = [(0, at(k * 37), float(k)) for k in range(50)]
    got = {r["v"]: r["b"] for r in scans.with_lag(spark.createDataFrame(rows, "k int, t timestamp_ntz, v double"), ["k"], ["t"], "v", "b", scans.HOUR).collect()}
    assert got == {float(k): float(k - 1) if k else None for k in range(50)}


def test_runs_across_buckets_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for device in (1, 2, 3, None):
        on, minute = False, 0
        for _ in range(400):
            on = on != (rng.random() < 0.03)
            minute += rng.choice([1, 5, 60, 60, 2000])
            rows.append((device, k, at(minute) if rng.random() < 0.98 else None, rng.choice([2.0, 9.0]) if on else rng.choice([0.0, None])))
            k += 1
    df = spark.createDataFrame(rows, "device int, id int, t timestamp_ntz, x double")
    got = {(r["device"], r["id"]): r["seg"] for r in segments.runs(df, Axis(("device",), "t", ("id",)), "x", 1.0).collect()}
    want = {}
    for device in (1, 2, 3, None):
        run, was, mine = 0, False, {}
        for _, id_, _, x in sorted((r for r in rows if r[0] == device), key=lambda r: (r[2] is not None, r[2] or START, r[1])):
            on = (x or 0) >= 1
            run += on and not was
            if on:
                mine[device, id_] = run
            was = on
        want |= {at_: n for at_, n in mine.items() if not (was and n == run)}
    assert got == want and len({n for n in want.values()}) > 3


@pytest.mark.parametrize("descending", [False, True])
def test_truth_events_across_buckets_equal_a_plain_loop(spark, descending):
    rng = random.Random(5)
    rows, minute, q = [], 0, 0.0
    for k in range(600):
        minute += rng.choice([1, 30, 300])
        q += rng.choice([0.0, 0.0, 1.0]) if k % 40 < 20 else 1.0
        rows.append((1, at(minute), None if rng.random() < 0.02 else q))
    got = series.truth_events(spark.createDataFrame(rows, "device int, t timestamp_ntz, q double"), Axis(), "q", descending).collect()
    kept = [r for r in rows if descending or r[2] is not None]
    changed = [k > 0 and not (kept[k][2] is not None and kept[k][2] == kept[k - 1][2]) for k in range(len(kept))]
    want = []
    for k, now in enumerate(changed):
        if now and not changed[k - 1]:
            last = next((n for n in range(k, len(kept)) if not changed[n]), len(kept))
            want.append((kept[k][1], kept[last - 1][1] if descending or last == len(kept) else kept[last][1]))
    assert sorted((r["starttime"], r["endtime"]) for r in got) == want


def plain_matches(truth, signal, pumps):
    out = {}
    for pump in pumps:
        s = sorted((t, v) for p, t, v in signal if p == pump)
        res = dict(s=0, e=0, ds=[], de=[], alike=0.0)
        for vs, ve in truth:
            for side, lo, hi in (("s", vs - dt.timedelta(hours=1), vs), ("e", ve - dt.timedelta(hours=1), ve), ("w", vs, ve)):
                w = [(t, v) for t, v in s if lo <= t <= hi]
                d = [(abs(b[1] - a[1]), b[0]) for a, b in itertools.pairwise(w)]
                if side == "w":
                    if len(d) > 1:
                        x = np.array([v for v, _ in d])
                        res["alike"] += 1 - x.std(ddof=1) / (x.mean() + 1e-6)
                elif d and max(d)[0] > 0.1:
                    top = max(v for v, _ in d)
                    when = min(t for v, t in d if v == top)
                    res[side] += 1
                    res["d" + side].append(abs((when - hi).total_seconds()) / 60)
        n = len(truth)
        mean = lambda v: sum(v) / len(v) if v else None
        out[pump] = (res["s"] / n, res["e"] / n, mean(res["ds"]), mean(res["de"]), res["alike"] / n)
    return out


@pytest.fixture(scope="module")
def pumps_and_truth():
    rng = random.Random(3)
    minutes = sorted(rng.sample(range(0, 4000), 700))
    signal = [(p, at(m), rng.choice([0.0, 0.0, 5.0, 5.05, 30.0, rng.random() * 100])) for m in minutes for p in "abc" if rng.random() < (0.2 if 1000 < m < 2000 else 0.9)]
    starts = [rng.randrange(-100, 4100) for _ in range(60)] + [60, 120, 180, 240]
    return signal, [(at(a), at(a + rng.choice([0, 3, 30, 59, 60, 61, 200, 900]))) for a in starts]


def test_pump_matches_equal_a_plain_loop(spark, pumps_and_truth):
    signal, truth = pumps_and_truth
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(truth)], "vid long, vs timestamp_ntz, ve timestamp_ntz")
    got = {r["pump"]: tuple(r)[1:] for r in metrics.pump_matches(df, spark.createDataFrame(signal, "pump string, t timestamp_ntz, value double")).collect()}
    want = plain_matches(truth, signal, "abc")
    for pump in "abc":
        assert got[pump] == pytest.approx(want[pump], rel=1e-9, abs=1e-9)


def test_rows_grow_with_samples_plus_events(spark, pumps_and_truth):
    """Ten times as many samples in the same time: a join by time would give a hundred times the rows for ten times both."""
    made = []
    for n in (1, 4):
        signal = spark.range(200 * n).select(F.lit("a").alias("pump"), F.timestamp_add("SECOND", (F.col("id") * 600 / n).cast("int"), F.lit(START).cast("timestamp_ntz")).alias("t"), (F.col("id") % 7).cast("double").alias("value"))
        at_ = F.timestamp_add("SECOND", (F.col("id") * 1200 / n).cast("int"), F.lit(START).cast("timestamp_ntz"))
        truth = spark.range(100 * n).select(F.col("id").alias("vid"), at_.alias("vs"), F.timestamp_add("HOUR", F.lit(3), at_).alias("ve"))
        plan = metrics.pump_matches(truth, signal)
        assert plan.count() == 1
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text
        marks = metrics.running_steps(signal, "pump").count()
        made.append(marks + 4 * truth.count())
    assert made[1] == 4 * made[0]


def test_quantiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(segments, "BINS", 8)
    rng = np.random.default_rng(2)
    groups = {1: rng.normal(size=500), 2: np.repeat(3.0, 40), 3: np.array([7.5]), 4: 10.0 ** rng.uniform(-8, 8, 300), 5: np.concatenate([np.zeros(300), [1e300, -1e300]]), None: rng.integers(0, 5, 99).astype(float)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [(1, None), (1, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r["g"]: tuple(r)[1:] for r in segments.quartiles(df.where("g is not null"), ["g"], "x").collect()}
    for g, x in groups.items():
        if g is not None:
            assert got[g] == pytest.approx((x.min(), *np.quantile(x, [0.25, 0.5, 0.75]), x.max()), rel=1e-12), g


def test_halves_meet_in_the_middle():
    rng = random.Random(4)
    powers = [37.5, 12.5, 25.0, 110.25, 3.3, 0.1]
    sets = list(itertools.product(range(4), repeat=6))
    total = lambda c: c[0] * powers[0] + c[1] * powers[1] + c[2] * powers[2] + c[3] * powers[3] + c[4] * powers[4] + c[5] * powers[5]
    x = [rng.uniform(-50, 800) for _ in range(40)] + [0.0, 75.0, 112.5, 1e6]
    counts, off = blocks.nearest_combinations(np.array(x), powers, 3)
    for v, c, d in zip(x, counts.tolist(), off.tolist(), strict=True):
        best = min((abs(total(s) - v), s) for s in sets)
        assert d == pytest.approx(best[0], abs=1e-9) and (abs(total(c) - v) == pytest.approx(best[0], abs=1e-9))


def test_many_rows_look_at_a_table_of_sums(monkeypatch):
    powers = [31.25 + 17.5 * k + k * k for k in range(7)]
    x = np.random.default_rng(3).uniform(-10, 1500, 300).round(2)
    table = blocks.nearest_combinations(x, powers, 3)
    assert blocks.nearest_combinations(np.resize(x, 200_000), powers, 3)[1].shape == (200_000,)  # took half a minute row by row
    monkeypatch.setattr(blocks, "different_sums", lambda *a: None)
    plain = blocks.nearest_combinations(x, powers, 3)
    assert (table[0] == plain[0]).all() and (table[1] == plain[1]).all()


def test_combinations_of_missing_values(spark):
    df = spark.createDataFrame([(1, 100.0), (2, None), (3, float("nan")), (4, 0.0)], "id int, x double")
    got = {r["id"]: (r["counts"], r["residual"]) for r in blocks.residual_combinations(df, "x", [10.0] * 7, 3).collect()}
    assert sum(got[1][0]) == 10 and got[1][1] == 0 and got[2] == got[3] == (None, None) and got[4] == ([0] * 7, None)


def test_pump_matches_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(scans, "TASK_ROWS", 40, raising=False)
    start = "timestamp_ntz'2024-01-01 00:00:00'"
    signal = spark.range(240).select(F.lit("p").alias("pump"), F.expr(f"{start} + make_interval(0, 0, 0, 0, 0, id * 15)").alias("t"), (F.col("id") % 7).cast("double").alias("value"))
    truth = spark.range(20).select(F.col("id").alias("vid"), F.expr(f"{start} + make_interval(0, 0, 0, 0, id * 3)").alias("vs"), F.expr(f"{start} + make_interval(0, 0, 0, 0, id * 3 + 2)").alias("ve"))
    looks, real = [], scans.with_neighbours
    monkeypatch.setattr(scans, "with_neighbours", lambda *a, **k: looks.append(real(*a, **k)) or looks[-1])
    found = metrics.pump_matches(truth, signal).first()
    assert found["start_detection_rate"] == 0.95  # no change before the first event
    assert looks[0].select(F.spark_partition_id()).distinct().count() > 1
