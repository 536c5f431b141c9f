"""From readings to scores, with clusters that the k-means search finds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattloom.functions.columns import Axis
from wattloom.operators import clustering
from wattloom.plans import pipeline

START = dt.datetime(2024, 1, 1)
POWERS = (50.0, 120.0)


def meter(spark, events):
    """Readings by the minute and the second pump's true series: events of one pump, the other, or both for a while, in turn."""
    rng = random.Random(1)
    readings, second = [0.0] * 10, [0.0] * 10
    for e in range(events):
        pumps = [[0], [1], [0, 1]][e % 3]
        for k in range(60):
            on = [p for p in pumps if p == pumps[0] or 20 <= k < 40]
            readings.append(sum(POWERS[p] for p in on) + rng.uniform(-0.2, 0.2))
            second.append(POWERS[1] if 1 in on else 0.0)
        readings += [0.0] * 10
        second += [0.0] * 10
    minutes = [START + dt.timedelta(minutes=k) for k in range(len(readings))]
    rows = spark.createDataFrame([("d", m, x) for m, x in zip(minutes, readings, strict=True)], "device string, t timestamp_ntz, x double")
    return rows, spark.createDataFrame(list(zip(minutes, second, strict=True)), "minute timestamp_ntz, value double")


def test_auto_test_equals_its_steps(spark):
    rows, truth = meter(spark, 12)
    got = [r.asDict() for r in pipeline.auto_test(rows, Axis(), "x", {"real": "x"}, truth, "ave_real").orderBy("cluster").collect()]
    assert got and any(r["time_matching"] > 0 for r in got)
    ready = pipeline.prepared(rows, Axis(), "x", {"real": "x"})
    assert ready.events.where("is_mono").count() == 8 and ready.events.count() == 12
    names = [c for c in ready.features.columns if c not in ("device", "seg")]
    points = ready.scaled.fillna(0.0, names).withColumn("id", F.xxhash64("device", "seg"))
    labelled, _, k = clustering.search(points, names, "si")
    labels = {r["seg"]: r["cluster"] for r in labelled.collect()}
    assert len(labels) == 8 and set(labels.values()) == set(range(k))
    known = spark.createDataFrame([("d", *x) for x in labels.items()], "device string, seg long, cluster int")
    records, powers = pipeline.records_of(ready, Axis(), "x", known, "ave_real")
    want = [r.asDict() for r in pipeline.evaluated(records, powers, truth).orderBy("cluster").collect()]
    assert [r["cluster"] for r in got] == [r["cluster"] for r in want]
    assert all(a == pytest.approx(b, nan_ok=True) for a, b in zip(got, want, strict=True))


def test_auto_test_of_few_events(spark):
    rows, truth = meter(spark, 3)  # two events of one kind: no labelling has two clusters of two
    assert pipeline.auto_test(rows, Axis(), "x", {"real": "x"}, truth, "ave_real").count() == 0
    with pytest.raises(ValueError):
        pipeline.auto_test(meter(spark, 1)[0], Axis(), "x", {"real": "x"}, truth, "ave_real")
