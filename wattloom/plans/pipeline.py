"""The chains from readings to features, from events to records, and from records to scores."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.columns import Axis, power_estimate
from wattloom.functions.session import with_checkpoints
from wattloom.operators import blocks, clustering, features, metrics, segments, series

POWER_FEATURES = ("std", "ave", "trend", "max")


class Prepared(NamedTuple):
    """Samples of events (with seg), events (with is_mono), raw features and features scaled to 0..1 of mono events."""

    samples: DataFrame
    events: DataFrame
    features: DataFrame
    scaled: DataFrame


def with_proxy(samples: DataFrame) -> DataFrame:
    """samples with realP_proxy and reacP_proxy, estimated from phases A, B and C (current: B and C)."""
    real, reactive = power_estimate([f"factor_{p}" for p in "ABC"], ["curnt_B", "curnt_C"], [f"volt_{p}" for p in "ABC"])
    return samples.withColumns({"realP_proxy": real, "reacP_proxy": reactive})


def prepared(samples: DataFrame, axis: Axis, signal: str, measures: dict[str, str], threshold: float = 1.0, more_minutes: float = 10.0, variance: float = 1.0, factors: tuple[str, ...] = (), dry_only: bool = False) -> Prepared:
    """Segments, kinds, features and scaled features of a meter's samples. The key's shuffle serves all steps up to scaling."""
    found = segments.segments(samples, axis, signal, threshold, more_minutes, factors)
    rows = segments.runs(samples, axis, signal, threshold).join(found.select(*axis.key, "seg"), [*axis.key, "seg"], "left_semi")
    events = segments.classified(found, segments.pulses(rows, axis, signal), axis, variance)
    mono = rows.join(events.where("is_mono").select(*axis.key, "seg"), [*axis.key, "seg"], "left_semi")
    made = features.event_features(mono, axis, measures, next(iter(measures.values())))
    if dry_only:
        dry = features.modal_month(mono, axis).where("dry").select(*axis.key, "seg")
        made = made.join(dry, [*axis.key, "seg"], "left_semi")
    names = [c for c in made.columns if c not in (*axis.key, "seg")]
    return Prepared(rows, events, made, features.min_max(made, names))


def records_of(ready: Prepared, axis: Axis, signal: str, labels: DataFrame, power: str, threshold: float = 10.0, second: float = 3.0, first: int = 0, last: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, powers): every event decomposed into on/off records, the other events (from index `first` up to `last`) twice; labels: (key, seg, cluster)."""
    powers = blocks.cluster_power(ready.features.join(labels, [*axis.key, "seg"]), "cluster", power)
    centres = [(r["cluster"], r["power"]) for r in powers.collect()]  # a row for each cluster
    event = Axis((*axis.key, "seg"), axis.time, axis.tie)
    others = ready.samples.join(ready.events.where("not is_mono").select(*axis.key, "seg"), [*axis.key, "seg"], "left_semi")
    return blocks.decomposed(ready.samples, others, event, signal, centres, threshold, second, first, last), powers


def evaluated(records: DataFrame, powers: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics of each cluster's rebuilt series against the true one (minute, value), on every minute of both."""
    rebuilt = series.minute_series(records, powers).select("cluster", "minute", F.col("signal").alias("value"))
    return metrics.keyed_metrics(rebuilt, truth, ["cluster"])


def evaluated_files(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics of each prediction file (file, t, workingPower) against the true series (minute, value), in one job.

    A file's samples are brought to whole minutes by the nearest one; a minute that it does not have counts as 0.
    """
    by_minute = series.resample_nearest(predictions, Axis(("file",), "t"), "workingPower")
    return metrics.keyed_metrics(by_minute, truth, ["file"])


def auto_test(samples: DataFrame, axis: Axis, signal: str, measures: dict[str, str], truth: DataFrame, power: str, score: str = "si", **how) -> DataFrame:
    """From readings to the clusters' metrics: k-means search on the scaled features, decomposition, evaluation.

    The events' features and their labels are checkpointed (a row for each event): the fits start from them, and the plans of
    decomposition and evaluation do not hold the expressions of all features for each centre. No metrics where no labelling has
    clusters of the least size.
    """
    with_checkpoints(samples.sparkSession)
    ready = prepared(samples, axis, signal, measures, **how)
    ready = ready._replace(features=ready.features.checkpoint())
    names = [c for c in ready.features.columns if c not in (*axis.key, "seg")]
    scaled = features.min_max(ready.features, names).select(*axis.key, "seg", *names).fillna(0.0, names)
    rows = scaled.withColumn("id", F.xxhash64(*axis.key, "seg")).checkpoint()
    labelled, _, _ = clustering.search(rows, names, score)
    if labelled is None:
        labels = ready.features.select(*axis.key, "seg", F.lit(None).cast("int").alias("cluster")).limit(0)
    else:
        labels = labelled.select(*axis.key, "seg", "cluster").checkpoint()
    records, powers = records_of(ready, axis, signal, labels, power)
    return evaluated(records, powers, truth)
