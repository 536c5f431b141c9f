"""Features of events, scaling, and selection of features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import Axis, known

TRANSIENT_ROWS, LEAST_STEADY, MOST_MISSING = 5, 10, 0.2


def event_features(event_samples: DataFrame, axis: Axis, measures: dict[str, str], check: str) -> DataFrame:
    """std, ave, trend (steady part) and max (first rows) of each measure, and the event's modal month.

    measures: name -> column. Events with fewer than LEAST_STEADY steady rows, or more than MOST_MISSING of `check`
    missing among them, are left out. Missing values are skipped. One group per event.
    """
    w = axis.window("seg")
    rows = event_samples.withColumn("_rn", F.row_number().over(w))
    rows = rows.withColumn("_t0", F.min(F.when(F.col("_rn") > TRANSIENT_ROWS, F.col(axis.time))).over(Window.partitionBy(*axis.key, "seg")))
    steady = F.col("_rn") > TRANSIENT_ROWS
    elapsed = F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col(axis.time)) / 60e6
    aggs: list[Column] = []
    for name, column in measures.items():
        value = known(F.col(column).cast("double"))
        late, early = F.when(steady, value), F.when(~steady, value)
        aggs += [F.stddev_pop(late).alias(f"std_{name}"), F.avg(late).alias(f"ave_{name}"), F.regr_slope(late, F.when(steady, elapsed)).alias(f"trend_{name}"), F.max(early).alias(f"max_{name}")]
    missing = F.count_if(steady & known(F.col(check).cast("double")).isNull())
    found = rows.groupBy(*axis.key, "seg").agg(*aggs, F.count_if(steady).alias("_steady"), missing.alias("_missing"))
    usable = found.where((F.col("_steady") >= LEAST_STEADY) & (F.col("_missing") <= MOST_MISSING * F.col("_steady"))).drop("_steady", "_missing")
    return usable


def modal_month(event_samples: DataFrame, axis: Axis) -> DataFrame:
    """(key, seg, month, dry): the most frequent month of an event's samples (the first on ties), and whether it is February to June."""
    counts = event_samples.groupBy(*axis.key, "seg", F.month(axis.time).alias("month")).count()
    best = counts.groupBy(*axis.key, "seg").agg(F.min_by("month", F.struct(-F.col("count"), "month")).alias("month"))
    return best.withColumn("dry", F.col("month").between(2, 6))


def min_max(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant column becomes null."""
    ends = features.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    both = features.crossJoin(F.broadcast(ends))  # one row
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in columns}
    return both.withColumns(scaled).select(features.columns)


def z_score(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean by their sample deviation; a constant column becomes null."""
    ends = features.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    both = features.crossJoin(F.broadcast(ends))  # one row
    return both.withColumns({c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")) for c in columns}).select(features.columns)


def correlations(features: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, corr) of each pair, in one aggregate."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = features.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def selected(features: DataFrame, columns: list[str], keep: list[str]) -> list[str]:
    if not keep:
        raise ValueError("name the columns to keep")
    return [c for c in columns if c in keep]


def dropped(features: DataFrame, columns: list[str], drop: list[str]) -> list[str]:
    return [c for c in columns if c not in drop]


def by_correlation(features: DataFrame, columns: list[str], threshold: float = 0.5) -> list[str]:
    """Without each column that an earlier one (kept or not) correlates with beyond the threshold."""
    rows = correlations(features, columns).where(F.abs("corr") > threshold).select("right").distinct().collect()  # at most the columns
    return [c for c in columns if c not in {r["right"] for r in rows}]


def by_variance(features: DataFrame, columns: list[str], threshold: float = 0.01) -> list[str]:
    row = features.agg(*(F.var_pop(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] is not None and row[c] > threshold]


def variance_ratios(features: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(name, score): the F value of the analysis of variance of each column by the classes of `label`; null without spread inside the classes."""
    rows = features.where(F.col(label).isNotNull())
    classes = rows.groupBy(label).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))))
    whole = rows.agg(*(F.avg(c).alias(f"_g_{c}") for c in columns))
    both = classes.crossJoin(F.broadcast(whole))  # one row
    scores = []
    for c in columns:
        n, mean, grand = F.col(f"_n_{c}"), F.col(f"_m_{c}"), F.col(f"_g_{c}")
        between, inside = F.sum(n * (mean - grand) * (mean - grand)), F.sum(n * F.col(f"_v_{c}"))
        scores.append(F.try_divide(F.try_divide(between, F.count(mean) - 1), F.try_divide(inside, F.sum(n) - F.count(mean))).alias(c))
    row = both.agg(*scores)
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("score")) for c in columns))).alias("r")).select("r.*")


def by_best(features: DataFrame, columns: list[str], label: str, k: int = 5) -> list[str]:
    """The k columns with the highest variance ratios by the classes of `label`, in their order; of equal ones the first."""
    scores = {r["name"]: r["score"] for r in variance_ratios(features, columns, label).collect()}  # at most the columns
    best = sorted(columns, key=lambda c: (scores[c] is None, -(scores[c] or 0.0), columns.index(c)))[:k]
    return [c for c in columns if c in best]


def by_lasso(features: DataFrame, columns: list[str], label: str, alpha: float = 0.1) -> list[str]:
    """The columns with a weight in the L1 regression of the number `label` on them."""
    rows = assembled(features.where(F.col(label).isNotNull()), columns)
    model = LinearRegression(featuresCol="_v", labelCol=label, regParam=alpha, elasticNetParam=1.0, standardization=False).fit(rows)
    return [c for c, w in zip(columns, model.coefficients.toArray(), strict=True) if w != 0]


SELECTORS: dict[str, Callable] = {"selected": selected, "remove": dropped, "corr": by_correlation, "variance": by_variance, "kbest": by_best, "lasso": by_lasso}


def select_features(features: DataFrame, keys: list[str], columns: list[str], method: str, **how) -> DataFrame:
    """keys and the chosen columns; `pca` gives new ones."""
    if method == "pca":
        return pca_scores(features, keys, columns, **how)
    return features.select(*keys, *SELECTORS[method](features, columns, **how))


def assembled(features: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_v").transform(features.dropna(subset=columns))


def pca_scores(features: DataFrame, keys: list[str], columns: list[str], n: int = 5) -> DataFrame:
    """keys and PC0.. of the standardised columns (population deviation); each component's largest loading is positive."""
    rows = assembled(features, columns)
    scaled = StandardScaler(inputCol="_v", outputCol="_z", withMean=True).fit(rows).transform(rows)
    count = scaled.count()
    model = PCA(k=n, inputCol="_z", outputCol="_p").fit(scaled)
    loads = model.pc.toArray()
    signs = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in loads.T]
    grow = (count / max(count - 1, 1)) ** 0.5
    out = model.transform(scaled).withColumn("_a", vector_to_array("_p"))
    return out.select(*keys, *((F.col("_a")[k] * (signs[k] * grow)).alias(f"PC{k}") for k in range(n)))
