"""Queries over the driver's tables, each with its SQL twin where SQL expresses it.

events are the readings: a user is a device, `value` the signal. All windows are ordered by (ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import Axis, power_estimate
from wattloom.operators import blocks, clustering, features, metrics, mixture, segments, series, smoothing
from wattloom.plans import pipeline
from wattloom.sources import meter

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DEVICE = Axis(("device",), "t", ("event_id",))
KIND = Axis(("kind",), "t", ("event_id",))
EVENT = Axis(("device", "seg"), "t", ("event_id",))
CENTRES = [(0, 60.0), (1, 150.0), (2, 280.0)]
COORDINATES = ["x0", "x1", "x2", "x3"]

EV = "ev AS (SELECT user_id AS device, ts AS t, event_id, value AS x, event_type AS kind FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("device"), F.col("ts").alias("t"), "event_id", F.col("value").alias("x"), F.col("event_type").alias("kind"))


def r4(c: str | Column, name: str | None = None) -> Column:
    return (F.round(c, 4) + 0.0).alias(name or c)


def runs_sql(threshold: float) -> str:
    """CTEs from `ev` up to `runs`: the rows of finished runs, with seg."""
    return f"""m AS (SELECT *, x >= {threshold} AS ison, coalesce(lag(x >= {threshold}) OVER w, false) AS was, lead(1) OVER w IS NULL AS islast FROM ev WINDOW w AS (PARTITION BY device ORDER BY t, event_id)),
    n AS (SELECT *, sum(CASE WHEN ison AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM m),
    o AS (SELECT *, max(islast::INT) OVER (PARTITION BY device, seg) AS isopen FROM n WHERE ison),
    runs AS (SELECT device, t, event_id, x, seg FROM o WHERE isopen = 0)"""


def segments_sql(threshold: float, more: float) -> str:
    return f"""{runs_sql(threshold)}, segs AS (SELECT device, seg, min(t) AS t_start, max(t) AS t_end, date_diff('microsecond', min(t), max(t)) / 60e6 AS duration_min, count(*) AS n, var_pop(x) AS variance
    FROM runs GROUP BY device, seg HAVING date_diff('microsecond', min(t), max(t)) / 60e6 > {more})"""


@query(f"WITH {EV} SELECT device, kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY device, kind ORDER BY event_id) AS k FROM ev) WHERE k = 1")
def dedup_keep_first(spark, sf):
    return meter.keep_first(readings(spark, sf), ["device", "kind"], "event_id").select("device", "kind", "event_id")


@query('SELECT event_id, value / 1000 AS "realP_A", abs(-value / 500) AS "factor_A", value AS "volt_A" FROM events')
def unit_scale_abs(spark, sf):
    raw = table(spark, sf, "events").select("event_id", F.col("value").alias("realP_A"), (-F.col("value") / 500).alias("factor_A"), F.col("value").alias("volt_A"))
    return meter.scaled(raw).select("event_id", "realP_A", "factor_A", "volt_A")


@query("""WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%m.%d.%Y %H:%M') ELSE strftime(ts, '%m.%d.%y %H:%M') END AS s FROM events)
SELECT event_id, coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%m.%d.%y %H:%M'), try_strptime(s, '%m.%d.%Y %H:%M')) AS t FROM s""")
def parse_mixed_timestamps(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM.dd.yyyy HH:mm")).otherwise(F.date_format("ts", "MM.dd.yy HH:mm"))
    return table(spark, sf, "events").select("event_id", meter.parsed(text).alias("t"))


@query("""WITH n AS (SELECT url, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)
SELECT regexp_extract(name, '^([^-]*(-[^-]*)?)', 1) AS device, string_agg(url, ' ' ORDER BY url) AS files FROM n GROUP BY 1""")
def device_file_groups(spark, sf):
    return meter.transformer_files(table(spark, sf, "pages"), "url").select("device", F.array_join("files", " ").alias("files"))


@query(f"WITH {EV}, {segments_sql(20, 10)} SELECT device, seg, t_start, t_end, duration_min, n, variance FROM segs")
def active_segments(spark, sf):
    return segments.segments(readings(spark, sf), DEVICE, "x", 20.0)


@query(f"WITH {EV}, {segments_sql(20, 10)} SELECT device, seg, n FROM segs JOIN (SELECT device, seg FROM runs GROUP BY device, seg HAVING NOT bool_and(x < 150)) USING (device, seg)")
def segments_factor_filter(spark, sf):
    rows = readings(spark, sf).withColumn("factor_B", F.when(F.col("x") < 150, 1.0).otherwise(0.5))
    return segments.segments(rows, DEVICE, "x", 20.0, factors=("factor_B",)).select("device", "seg", "n")


PULSES = """, steps AS (SELECT *, lag(x) OVER w AS b FROM runs WINDOW w AS (PARTITION BY device, seg ORDER BY t, event_id)), c AS (SELECT * FROM steps WHERE b IS NULL OR x <> b),
    p AS (SELECT device, seg, x > b AND x > lead(x) OVER (PARTITION BY device, seg ORDER BY t, event_id) AND x >= 5 AS peak FROM c), pulses AS (SELECT device, seg, count(*) FILTER (peak) AS pulses FROM p GROUP BY device, seg)"""


@query(f"WITH {EV}, {runs_sql(20)} {PULSES} SELECT * FROM pulses")
def pulse_count(spark, sf):
    return segments.pulses(segments.runs(readings(spark, sf), DEVICE, "x", 20.0), DEVICE, "x")


@query(f"WITH {EV}, {segments_sql(20, 10)} {PULSES} SELECT device, seg, pulses, variance < 500 OR pulses = 1 AS is_mono FROM segs JOIN pulses USING (device, seg)")
def mono_vs_other(spark, sf):
    rows = readings(spark, sf)
    events = segments.segments(rows, DEVICE, "x", 20.0)
    counted = segments.pulses(segments.runs(rows, DEVICE, "x", 20.0), DEVICE, "x")
    return segments.classified(events, counted, DEVICE, 500.0).select("device", "seg", "pulses", "is_mono")


@query("""WITH b AS (SELECT *, (l_discount + l_tax + l_discount) / 3 AS pf, 3 * ((l_quantity + l_linenumber) / 2) * ((l_extendedprice + l_extendedprice + l_quantity) / 3) / 1000 AS iv FROM lineitem)
SELECT l_orderkey, l_linenumber, pf * iv AS real_power, CASE WHEN pf <= 1 THEN sqrt(1 - pf * pf) * iv END AS reactive_power FROM b""")
def power_proxy(spark, sf):
    real, reactive = power_estimate(["l_discount", "l_tax", "l_discount"], ["l_quantity", "l_linenumber"], ["l_extendedprice", "l_extendedprice", "l_quantity"])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", real.alias("real_power"), reactive.alias("reactive_power"))


FEATURES = f"""WITH {EV}, {runs_sql(5)}, r AS (SELECT *, row_number() OVER (PARTITION BY device, seg ORDER BY t, event_id) AS rn FROM runs),
    s AS (SELECT *, min(t) FILTER (rn > 5) OVER (PARTITION BY device, seg) AS t0 FROM r),
    f AS (SELECT device, seg, stddev_pop(x) FILTER (rn > 5) AS std_x, avg(x) FILTER (rn > 5) AS ave_x, regr_slope(x, date_diff('microsecond', t0, t) / 60e6) FILTER (rn > 5) AS trend_x, max(x) FILTER (rn <= 5) AS max_x
    FROM s GROUP BY device, seg HAVING count(*) FILTER (rn > 5) >= 10)"""


def made_features(spark, sf):
    rows = segments.runs(readings(spark, sf), DEVICE, "x", 5.0)
    return features.event_features(rows, DEVICE, {"x": "x"}, "x")


@query(f"{FEATURES} SELECT device, seg, std_x, ave_x, trend_x, max_x FROM f")
def event_features(spark, sf):
    return made_features(spark, sf).select("device", "seg", "std_x", "ave_x", "trend_x", "max_x")


@query("""WITH c AS (SELECT o_custkey AS device, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT device, month::INT AS month, month BETWEEN 2 AND 6 AS dry FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY n DESC, month) AS k FROM c) WHERE k = 1""")
def modal_month_season(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("device"), F.lit(0).alias("seg"), F.col("o_orderdate").alias("t"))
    return features.modal_month(rows, Axis()).drop("seg")


@query(f"{FEATURES}, e AS (SELECT min(std_x) AS a, max(std_x) AS b, min(ave_x) AS c, max(ave_x) AS d FROM f) SELECT device, seg, round((std_x - a) / nullif(b - a, 0), 4) AS std_x, round((ave_x - c) / nullif(d - c, 0), 4) AS ave_x FROM f, e")
def minmax_features(spark, sf):
    return features.min_max(made_features(spark, sf), ["std_x", "ave_x"]).select("device", "seg", r4("std_x"), r4("ave_x"))


@query(f"{FEATURES}, e AS (SELECT avg(std_x) AS a, stddev_samp(std_x) AS b, avg(ave_x) AS c, stddev_samp(ave_x) AS d FROM f) SELECT device, seg, round((std_x - a) / nullif(b, 0), 4) AS std_x, round((ave_x - c) / nullif(d, 0), 4) AS ave_x FROM f, e")
def zscore_features(spark, sf):
    return features.z_score(made_features(spark, sf), ["std_x", "ave_x"]).select("device", "seg", r4("std_x"), r4("ave_x"))


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS corr FROM lineitem" for k, a in enumerate(LINE) for b in LINE[k + 1 :])


@query(f'SELECT "left", "right", round(corr, 6) AS corr FROM ({PAIRS})')
def corr_pairs(spark, sf):
    return features.correlations(table(spark, sf, "lineitem"), LINE).withColumn("corr", F.round("corr", 6))


@query(f"""SELECT c AS name FROM (VALUES {", ".join(f"('{c}')" for c in LINE)}) v(c) WHERE c NOT IN (SELECT "right" FROM ({PAIRS}) WHERE abs(corr) > 0.5)""")
def corr_select(spark, sf):
    return spark.createDataFrame([(c,) for c in features.by_correlation(table(spark, sf, "lineitem"), LINE)], "name string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name FROM lineitem HAVING var_pop({c}) > 0.01" for c in LINE))
def variance_select(spark, sf):
    return spark.createDataFrame([(c,) for c in features.by_variance(table(spark, sf, "lineitem"), LINE)], "name string")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smoothed FROM events")
def centered_moving_avg(spark, sf):
    return smoothing.smoothed(readings(spark, sf), DEVICE, "x", "centred").select("event_id", r4("smoothed"))


def lags(weights: list[float], first: int) -> str:
    return " + ".join(f"({w!r} * lag(x, {-(first + k)}) OVER w)" for k, w in enumerate(weights))


@query(f"""WITH {EV}, s AS (SELECT event_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY device) AS n, {lags(smoothing.MIDDLE, -2)} AS m, {lags(smoothing.EDGE0, 0)} AS a, {lags(smoothing.EDGE1, -1)} AS b,
    {lags(smoothing.EDGE1[::-1], -3)} AS c, {lags(smoothing.EDGE0[::-1], -4)} AS d FROM ev WINDOW w AS (PARTITION BY device ORDER BY t, event_id))
SELECT event_id, round(CASE WHEN rn = 1 THEN a WHEN rn = 2 THEN b WHEN rn = n - 1 THEN c WHEN rn = n THEN d ELSE m END, 4) AS smoothed FROM s""")
def savgol5(spark, sf):
    return smoothing.smoothed(readings(spark, sf), DEVICE, "x", "savgol").select("event_id", r4("smoothed"))


@query(f"""WITH {EV}, s AS (SELECT event_id, x, lag(x, 1) OVER w AS b1, lag(x, 2) OVER w AS b2, lead(x, 1) OVER w AS a1, lead(x, 2) OVER w AS a2 FROM ev WINDOW w AS (PARTITION BY device ORDER BY t, event_id))
SELECT event_id, round((x + exp(-2) * (coalesce(b1, x) + coalesce(a1, x)) + exp(-8) * (coalesce(b2, b1, a1) + coalesce(a2, a1, b1))) / (1 + 2 * exp(-2) + 2 * exp(-8)), 4) AS smoothed FROM s""")
def gauss5(spark, sf):
    return smoothing.smoothed(readings(spark, sf), DEVICE, "x", "gaussian").select("event_id", r4("smoothed"))


@query(f"WITH {EV}, s AS (SELECT event_id, row_number() OVER w AS rn, avg(x) OVER (PARTITION BY device ORDER BY t, event_id ROWS 4 PRECEDING) AS m FROM ev WINDOW w AS (PARTITION BY device ORDER BY t, event_id)) SELECT event_id, round(m, 4) AS smoothed FROM s WHERE rn >= 5")
def conv_valid(spark, sf):
    return smoothing.smoothed(readings(spark, sf), DEVICE, "x", "conv").where("smoothed is not null").select("event_id", r4("smoothed"))


def slide_sql(name: str, source: str, made: list[str]) -> str:
    """CTEs up to `name` (device, n, len, y): the windows of `source` one after the other, each value of a window (a, b, ...) as `made` says."""
    width, names = len(made), "abcd"[: len(made)]
    first = ", ".join(f"lead(y, {k}) OVER (PARTITION BY device ORDER BY n) AS {c}" for k, c in enumerate(names))
    after = ", ".join(f"p.{b} AS {a}" for a, b in zip(names, names[1:], strict=False))
    out = ", ".join(f"{m} AS {c}" for m, c in zip(made, names, strict=True))
    ends = "".join(f" UNION ALL SELECT device, n + {k}, len, {c} FROM {name}_f WHERE n = len - {width - 1}" for k, c in enumerate(names) if k)
    return f"""{name}_w AS (SELECT device, n, {out} FROM (SELECT device, n, len, {first} FROM {source}) WHERE n = 1 AND len >= {width}
        UNION ALL SELECT device, n, {out} FROM (SELECT p.device, p.n + 1 AS n, {after}, s.y AS {names[-1]} FROM {name}_w p JOIN {source} s ON s.device = p.device AND s.n = p.n + {width})),
    {name}_f AS (SELECT w.*, s.len FROM {name}_w w JOIN {source} s ON s.device = w.device AND s.n = w.n),
    {name} AS MATERIALIZED (SELECT device, n, len, a AS y FROM {name}_f{ends} UNION ALL SELECT device, n, len, y FROM {source} WHERE len < {width})"""


def repairs_sql(passes: list[list[str]]) -> str:
    names = [f"s{k}" for k in range(len(passes) + 1)]
    slides = ", ".join(slide_sql(names[k + 1], names[k], made) for k, made in enumerate(passes))
    return f"""WITH RECURSIVE {EV}, s0 AS MATERIALIZED (SELECT device, event_id, row_number() OVER (PARTITION BY device ORDER BY t, event_id) AS n, count(*) OVER (PARTITION BY device) AS len, x::DOUBLE AS y FROM ev), {slides}
SELECT s0.event_id, s.y AS smoothed, CASE WHEN s.y > 3 THEN s.y ELSE 0 END AS clipped FROM s0 JOIN {names[-1]} s ON s.device = s0.device AND s.n = s0.n"""


ALONE = "abs(c - a) < 1 AND abs(c + a - 2 * b) > 1"
PAIR = "CASE WHEN abs(d - a) < 1 AND abs(d + a - (b + c) / 2) > 1 THEN a + (d - a) / 2 ELSE"
DIP, SPIKE, FLAT = "b - a < -3 AND b - c < -3", "b - a > 3 AND b - c > 3", "abs(c - a) < 1 AND abs(b - a) < 1"
STEADY = f"WHEN {DIP} OR {SPIKE} THEN"
MEAN = f"WHEN {FLAT} THEN (a + b + c) / 3"
BRIDGE = "CASE WHEN abs(a - d) < 3 AND abs(b - a) > 3 AND abs(b - c) > 3 THEN (a + d) / 2 ELSE"


@query(repairs_sql([["a", f"CASE WHEN {ALONE} THEN a + (c - a) / 2 ELSE b END", "c"], ["a", f"{PAIR} b END", f"{PAIR} c END", "d"]]))
def repaired_signal(spark, sf):
    return smoothing.smoothed(readings(spark, sf), DEVICE, "x", "my").select("event_id", "smoothed", "clipped")


@query(repairs_sql([[f"CASE {STEADY} a {MEAN} ELSE a END", f"CASE WHEN {DIP} THEN c WHEN {SPIKE} THEN a {MEAN} ELSE b END", f"CASE {STEADY} c {MEAN} ELSE c END"], ["a", f"{BRIDGE} b END", f"{BRIDGE} c END", "d"]] * 2))
def levelled_signal(spark, sf):
    return smoothing.smoothed(readings(spark, sf), DEVICE, "x", "my2").select("event_id", "smoothed", "clipped")


BLOCKS = f"""WITH {EV}, s AS (SELECT *, avg(x) OVER (PARTITION BY device ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM ev),
    c AS (SELECT *, coalesce(abs(sm - lag(sm) OVER (PARTITION BY device ORDER BY t, event_id)) > 60, false) AS cut FROM s),
    n AS (SELECT *, sum(cut::INT) OVER (PARTITION BY device ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM c),
    d AS (SELECT device, t, x, b AS block FROM n UNION ALL SELECT device, t, x, b - 1 FROM n WHERE cut),
    blocks AS (SELECT device, block, min(t) AS b_start, max(t) AS b_end, avg(x) AS b_mean FROM d GROUP BY device, block HAVING min(t) < max(t)),
    deltas AS (SELECT *, coalesce(lead(b_mean) OVER (PARTITION BY device ORDER BY block) - b_mean, 0) AS delta FROM blocks)"""


def made_deltas(spark, sf):
    return blocks.block_deltas(blocks.change_blocks(readings(spark, sf), DEVICE, "x", 60.0), DEVICE)


@query(f"{BLOCKS} SELECT device, block, b_start, b_end, round(b_mean, 4) AS b_mean FROM blocks")
def change_blocks(spark, sf):
    return blocks.change_blocks(readings(spark, sf), DEVICE, "x", 60.0).select("device", "block", "b_start", "b_end", r4("b_mean"))


@query(f"{BLOCKS} SELECT device, block, round(delta, 4) AS delta FROM deltas")
def block_deltas(spark, sf):
    return made_deltas(spark, sf).select("device", "block", r4("delta"))


@query(f"{BLOCKS} SELECT device, block, arg_min(k, struct_pack(d := abs(delta - p), k := k)) AS cluster FROM deltas, (VALUES (0, 60.0), (1, 150.0), (2, 280.0)) v(k, p) GROUP BY device, block")
def nearest_cluster(spark, sf):
    return blocks.nearest_cluster(made_deltas(spark, sf), CENTRES).select("device", "block", "cluster")


def deltas_sql(rows: str, key: str, threshold: float, n: int) -> str:
    """CTEs from `rows` (key, t, event_id, x) up to `deltas{n}`."""
    order = f"(PARTITION BY {key} ORDER BY t, event_id"
    return f"""s{n} AS (SELECT *, avg(x) OVER {order} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM {rows}), c{n} AS (SELECT *, coalesce(abs(sm - lag(sm) OVER {order})) > {threshold}, false) AS cut FROM s{n}),
    n{n} AS (SELECT *, sum(cut::INT) OVER {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM c{n}), d{n} AS (SELECT {key}, t, x, b AS block FROM n{n} UNION ALL SELECT {key}, t, x, b - 1 FROM n{n} WHERE cut),
    blocks{n} AS (SELECT {key}, block, max(t) AS b_end, avg(x) AS b_mean FROM d{n} GROUP BY {key}, block HAVING min(t) < max(t)),
    deltas{n} AS (SELECT *, coalesce(lead(b_mean) OVER (PARTITION BY {key} ORDER BY block) - b_mean, 0) AS delta FROM blocks{n})"""


def paired_sql(key: str, n: int = 1) -> str:
    """CTEs from `deltas{n}` and `centres` (k, p) up to `records{n}`: a row of the recursion for each step, with what is open after it and what it has closed."""
    nearest = "list_position(list_transform(act, lambda a: abs(a.p + delta)), list_min(list_transform(act, lambda a: abs(a.p + delta))))"
    return f"""steps{n} AS MATERIALIZED (SELECT {key}, delta, b_end, row_number() OVER (PARTITION BY {key} ORDER BY block) AS n, max(b_end) OVER (PARTITION BY {key}) AS last,
        list_sort(list_transform((SELECT list(struct_pack(k := k, p := p)) FROM centres), lambda c: struct_pack(d := abs(delta - c.p), k := c.k)))[1].k AS k FROM deltas{n}),
    fold{n} AS (SELECT DISTINCT {key}, 0::BIGINT AS n, NULL::TIMESTAMP AS last, []::STRUCT(k INT, p DOUBLE, t TIMESTAMP)[] AS act, NULL::STRUCT(k INT, t0 TIMESTAMP, t1 TIMESTAMP, agg INT) AS rec FROM steps{n} UNION ALL
        SELECT {key}, n, last, CASE WHEN delta > 0 THEN list_append(act, struct_pack(k := k::INT, p := delta, t := b_end)) WHEN j IS NULL THEN act ELSE list_concat(act[1:j - 1], act[j + 1:]) END,
            CASE WHEN j IS NOT NULL THEN struct_pack(k := act[j].k, t0 := act[j].t, t1 := b_end, agg := (len(list_filter(act, lambda a: a.k = act[j].k)) - 1)::INT) END
        FROM (SELECT steps{n}.*, f.act, CASE WHEN delta < 0 AND len(f.act) > 0 THEN {nearest} END AS j FROM (SELECT {key}, n + 1 AS n, act FROM fold{n}) f JOIN steps{n} USING ({key}, n))),
    ends{n} AS (SELECT {key}, arg_max(act, n) AS act, max(last) AS last, count(rec) AS closed FROM fold{n} GROUP BY {key}),
    rest{n} AS (SELECT {key}, act, last, closed, unnest(range(1, len(act) + 1)) AS i FROM ends{n}),
    records{n} AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY n) - 1)::INT AS emission, rec.k AS "clusterId", rec.t0 AS starttime, rec.t1 AS endtime, rec.agg AS "aggNum" FROM fold{n} WHERE rec IS NOT NULL UNION ALL
        SELECT {key}, (closed + i - 1)::INT, act[i].k, act[i].t, last, len(list_filter(act[i + 1:], lambda a: a.k = act[i].k))::INT FROM rest{n})"""


CENTRES_SQL = f"centres AS (SELECT * FROM (VALUES {', '.join(map(str, CENTRES))}) v(k, p))"
PASSES = """both_ AS (SELECT *, 1 AS pass FROM records1 UNION ALL SELECT *, 2 FROM records2),
    records AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY pass, seg, emission)::INT AS "recordId" FROM both_)"""


@query(f"WITH RECURSIVE {EV}, {CENTRES_SQL}, {deltas_sql('ev', 'device', 60, 1)}, {paired_sql('device')} SELECT * FROM records1")
def on_off_records(spark, sf):
    return blocks.on_off_records(made_deltas(spark, sf), DEVICE, CENTRES)


@query(f"""WITH RECURSIVE {EV}, {CENTRES_SQL}, all_ AS (SELECT *, 0 AS seg FROM ev), others AS (SELECT * FROM all_ WHERE x > 5), {deltas_sql("all_", "device, seg", 60, 1)}, {paired_sql("device, seg", 1)},
    {deltas_sql("others", "device, seg", 30, 2)}, {paired_sql("device, seg", 2)}, {PASSES} SELECT * FROM records""")
def two_pass_records(spark, sf):
    rows = readings(spark, sf).withColumn("seg", F.lit(0))
    return blocks.decomposed(rows, rows.where("x > 5"), EVENT, "x", CENTRES, 60.0, 30.0)


@query("SELECT label AS cluster, round(avg(embedding[1]), 4) AS power, count(*) AS size FROM embeddings GROUP BY label")
def cluster_power(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("x", F.col("embedding")[0].cast("double"))
    return blocks.cluster_power(rows, "label", "x").select("cluster", r4("power"), "size")


@query("""WITH c AS (SELECT a, b, c FROM range(4) x(a), range(4) y(b), range(4) z(c)), d AS (SELECT event_id, value, a, b, c, abs(a * 37.5 + b * 110.25 + c * 240.125 - value) AS d FROM events, c),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, a, b, c) AS k FROM d) SELECT event_id, concat_ws(',', a, b, c) AS counts, round(d / nullif(abs(value), 0), 4) AS residual FROM k WHERE k = 1""")
def residual_enum(spark, sf):
    found = blocks.residual_combinations(table(spark, sf, "events"), "value", [37.5, 110.25, 240.125])
    return found.select("event_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"), r4("residual"))


RECORDS = f"{segments_sql(100, 1)}, records AS (SELECT (device % 5)::BIGINT AS \"clusterId\", t_start AS starttime, t_end AS endtime FROM segs)"


def made_records(spark, sf):
    found = segments.segments(readings(spark, sf), DEVICE, "x", 100.0, 1.0)
    return found.select((F.col("device") % 5).alias("clusterId"), F.col("t_start").alias("starttime"), F.col("t_end").alias("endtime"))


@query(f"""WITH {EV}, {RECORDS}, e AS (SELECT "clusterId", min(starttime) AS a, max(endtime) AS b FROM records GROUP BY 1), g AS (SELECT "clusterId" AS cluster, unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS minute FROM e)
SELECT g.cluster, g.minute, round(coalesce(sum(r.p), 0), 4) AS signal FROM g LEFT JOIN (SELECT *, ("clusterId" + 1) * 10.5 AS p FROM records) r ON r."clusterId" = g.cluster AND g.minute BETWEEN r.starttime AND r.endtime GROUP BY 1, 2""")
def minute_series(spark, sf):
    rows = made_records(spark, sf)
    powers = rows.select(F.col("clusterId").alias("cluster")).distinct().withColumn("power", (F.col("cluster") + 1) * 10.5)
    return series.minute_series(rows, powers).select("cluster", "minute", r4("signal"))


GRID = f"""WITH {EV}, e AS (SELECT kind, date_trunc('minute', min(t)) AS a, date_trunc('minute', max(t)) AS b FROM ev GROUP BY kind), g AS (SELECT kind, unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS g FROM e)"""


@query(f"""{GRID}, p AS (SELECT g.kind, g.g, ev.t AS t0, ev.x AS x0 FROM g ASOF LEFT JOIN ev ON g.kind = ev.kind AND g.g >= ev.t),
    q AS (SELECT p.*, ev.t AS t1, ev.x AS x1 FROM p ASOF LEFT JOIN ev ON p.kind = ev.kind AND p.g <= ev.t)
SELECT kind, g AS minute, CASE WHEN t0 IS NULL OR (t1 IS NOT NULL AND t1 - g < g - t0) THEN x1 ELSE x0 END AS value FROM q""")
def resample_nearest(spark, sf):
    return series.resample_nearest(readings(spark, sf), KIND, "x")


@query(f"""{GRID}, m AS (SELECT kind, date_trunc('minute', t) AS t, arg_max(x, event_id) AS x FROM ev WHERE second(t) < 20 GROUP BY 1, 2),
    p AS (SELECT g.kind, g.g, m.t AS t0, m.x AS x0 FROM g ASOF LEFT JOIN m ON g.kind = m.kind AND g.g >= m.t), q AS (SELECT p.*, m.t AS t1, m.x AS x1 FROM p ASOF LEFT JOIN m ON p.kind = m.kind AND p.g <= m.t)
SELECT kind, g AS minute, coalesce(x0 + (x1 - x0) * coalesce(date_diff('microsecond', t0, g) / nullif(date_diff('microsecond', t0, t1), 0), 0), x0) AS value FROM q""")
def resample_linear(spark, sf):
    rows = readings(spark, sf).withColumn("t", F.when(F.second("t") < 20, F.date_trunc("minute", "t").cast("timestamp_ntz")).otherwise(F.col("t")))
    return series.resample_linear(rows, KIND, "x")


#: A counter in whole hundredths, so that sums are exact in both engines.
COUNTER = f"{EV}, q AS (SELECT *, sum(CASE WHEN x > 150 THEN round(x * 100)::BIGINT ELSE 0 END) OVER (PARTITION BY device ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS q FROM ev)"


def counter(spark, sf):
    up = F.when(F.col("x") > 150, F.round(F.col("x") * 100).cast("long")).otherwise(0)
    return readings(spark, sf).withColumn("q", F.sum(up).over(DEVICE.window().rowsBetween(Window.unboundedPreceding, 0)))


@query(f"""WITH {COUNTER} SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE 10 * (q - lag(q) OVER w) / nullif(date_diff('microsecond', lag(t) OVER w, t) / 3.6e9, 0) END AS power FROM q WINDOW w AS (PARTITION BY device ORDER BY t, event_id)""")
def working_power(spark, sf):
    return series.working_power(counter(spark, sf), DEVICE, "q").select("event_id", "power")


def truth_sql(end: str) -> str:
    return f"""{COUNTER}, c AS (SELECT *, row_number() OVER w > 1 AND q <> lag(q) OVER w AS ch, lead(t) OVER w AS nx FROM q WINDOW w AS (PARTITION BY device ORDER BY t, event_id)),
    l AS (SELECT *, lag(ch) OVER (PARTITION BY device ORDER BY t, event_id) AS before FROM c),
    s AS (SELECT *, sum((coalesce(ch, false) AND NOT coalesce(before, false))::INT) OVER (PARTITION BY device ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
    truth AS (SELECT device, run, min(t) AS starttime, {end} AS endtime FROM s WHERE ch GROUP BY device, run)"""


ASCENDING = truth_sql("max(coalesce(nx, t))")


@query(f"WITH {ASCENDING} SELECT device, starttime, endtime FROM truth")
def truth_events_asc(spark, sf):
    return series.truth_events(counter(spark, sf), DEVICE, "q")


@query(f"WITH {truth_sql('max(t)')} SELECT device, starttime, endtime FROM truth")
def truth_events_desc(spark, sf):
    return series.truth_events(counter(spark, sf), DEVICE, "q", descending=True)


METRICS = """WITH a AS (SELECT event_id // 2 AS k, greatest(value - 150, 0) AS p FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id // 2 + 1 AS k, greatest(value - 150, 0) AS v FROM events WHERE event_id % 2 = 1),
    j AS (SELECT coalesce(a.k, b.k) % 10 AS series, p, v FROM a FULL JOIN b ON a.k = b.k),
    m AS (SELECT series, 1 - coalesce(sum(v) FILTER (p < v), 0) / nullif(sum(v), 0) AS inclusion, (sum(v) - coalesce(sum(v) FILTER (p < v), 0)) / nullif(sum(p), 0) AS matching,
    1 - count(*) FILTER (p < v) / nullif(count(*) FILTER (v > 0), 0) AS time_inclusion, count(*) FILTER (p > 0 AND v > 0) / nullif(count(*) FILTER (p > 0 OR v > 0), 0) AS time_matching,
    least(count(*) FILTER (p > 0), count(*) FILTER (v > 0)) / nullif(count(*) FILTER (p > 0), 0) AS time_matching_ratio, sum(v) / nullif(sum(p), 0) AS information_ratio,
    avg(abs(p - v)) FILTER (v > 0) AS active_error, avg(abs(p - v)) FILTER (v <= 0) AS inactive_error, avg((p - v) * (p - v)) AS mse, avg(abs(p - v)) AS mae FROM j GROUP BY series)"""
NAMES = ["inclusion", "matching", "time_inclusion", "time_matching", "time_matching_ratio", "information_ratio", "active_error", "inactive_error", "mse", "mae"]


def made_metrics(spark, sf):
    over = F.greatest(F.col("value") - 150, F.lit(0.0)).alias("value")
    rows = table(spark, sf, "events")
    k = F.floor(F.col("event_id") / 2)
    pairs = metrics.aligned(rows.where("event_id % 2 = 0").select(k.alias("k"), over), rows.where("event_id % 2 = 1").select((k + 1).alias("k"), over), ["k"])
    return metrics.metrics(pairs.withColumn("series", F.col("k") % 10), ["series"])


@query(f"{METRICS} SELECT series, {', '.join(f'round({c}, 4) AS {c}' for c in NAMES)} FROM m")
def metrics_all(spark, sf):
    return made_metrics(spark, sf).select("series", *(r4(c) for c in NAMES))


@query(f"{METRICS} SELECT series, round(mse, 4) AS mse FROM m ORDER BY mse, series LIMIT 1")
def best_signal(spark, sf):
    return metrics.best(made_metrics(spark, sf), -F.col("mse"), ["series"]).select("series", r4("mse"))


TRUTH = f"{ASCENDING}, tv AS (SELECT row_number() OVER (ORDER BY starttime, endtime, device) AS vid, starttime AS vs, endtime AS ve FROM truth)"


def made_truth(spark, sf):
    found = series.truth_events(counter(spark, sf), DEVICE, "q")
    return found.select(F.xxhash64("device", "starttime", "endtime").alias("vid"), F.col("starttime").alias("vs"), F.col("endtime").alias("ve"))


@query(f"""WITH {TRUTH}, {RECORDS}, u AS (SELECT DISTINCT "clusterId" AS cluster FROM records),
    h AS (SELECT u.cluster, tv.vid, EXISTS (SELECT 1 FROM records r WHERE r."clusterId" = u.cluster AND r.starttime BETWEEN tv.vs - INTERVAL 1 HOUR AND tv.vs) AS s,
    EXISTS (SELECT 1 FROM records r WHERE r."clusterId" = u.cluster AND r.endtime BETWEEN tv.ve - INTERVAL 2 HOUR AND tv.ve - INTERVAL 1 HOUR) AS e FROM u, tv)
SELECT cluster, round(count(*) FILTER (s) / count(*), 4) AS start_accuracy, round(count(*) FILTER (e) / count(*), 4) AS end_accuracy, count(*) AS total_validation_events, count(*) FILTER (s) AS correct_starts, count(*) FILTER (e) AS correct_ends FROM h GROUP BY cluster""")
def window_accuracy(spark, sf):
    found = metrics.window_accuracy(made_records(spark, sf).withColumnRenamed("clusterId", "cluster"), made_truth(spark, sf))
    return found.select("cluster", r4("start_accuracy"), r4("end_accuracy"), "total_validation_events", "correct_starts", "correct_ends")


def part_sql(name: str, lo: str, hi: str) -> str:
    return f"""{name} AS (SELECT pump, vid, coalesce(bool_or(d > 0.1), false) AS found, arg_max(t, struct_pack(d := coalesce(d, -1), k := -epoch_us(t))) AS at, stddev_samp(d) AS sd, avg(d) AS mean FROM
    (SELECT ev.kind AS pump, vid, t, abs(x - lag(x) OVER (PARTITION BY ev.kind, vid ORDER BY t)) AS d FROM tv JOIN ev ON t BETWEEN {lo} AND {hi}) GROUP BY 1, 2)"""


PUMPS = f"""WITH {TRUTH}, {part_sql("s1", "vs - INTERVAL 1 HOUR", "vs")}, {part_sql("e1", "ve - INTERVAL 1 HOUR", "ve")}, {part_sql("w1", "vs", "ve")},
    pumps AS (SELECT DISTINCT kind AS pump FROM ev),
    pm AS (SELECT pump, count(*) FILTER (s1.found) / count(*) AS start_detection_rate, count(*) FILTER (e1.found) / count(*) AS end_detection_rate,
    avg(abs(date_diff('microsecond', s1.at, vs)) / 6e7) FILTER (s1.found) AS avg_start_time_diff, avg(abs(date_diff('microsecond', e1.at, ve)) / 6e7) FILTER (e1.found) AS avg_end_time_diff,
    coalesce(sum(1 - w1.sd / (w1.mean + 1e-6)), 0) / count(*) AS avg_power_pattern_similarity FROM pumps CROSS JOIN tv LEFT JOIN s1 USING (pump, vid) LEFT JOIN e1 USING (pump, vid) LEFT JOIN w1 USING (pump, vid) GROUP BY pump),
    ps AS (SELECT *, coalesce(1 / (1 + (avg_start_time_diff + avg_end_time_diff) / 2), 0) AS time_accuracy FROM pm)"""
RATES = ["start_detection_rate", "end_detection_rate", "avg_start_time_diff", "avg_end_time_diff", "avg_power_pattern_similarity"]


def made_pumps(spark, sf):
    return metrics.pump_matches(made_truth(spark, sf), readings(spark, sf).select(F.col("kind").alias("pump"), "t", F.col("x").alias("value")))


@query(f"{PUMPS} SELECT pump, {', '.join(f'round({c}, 4) AS {c}' for c in RATES)} FROM pm")
def pump_event_match(spark, sf):
    return made_pumps(spark, sf).select("pump", *(r4(c) for c in RATES))


@query(f"{PUMPS} SELECT pump, round(0.3 * start_detection_rate + 0.3 * end_detection_rate + 0.2 * time_accuracy + 0.2 * avg_power_pattern_similarity, 4) AS total_score FROM ps ORDER BY 2 DESC, 1 LIMIT 1")
def best_pump(spark, sf):
    return metrics.best(metrics.pump_scores(made_pumps(spark, sf)), F.round("total_score", 4), ["pump"]).select("pump", r4("total_score"))


@query(f"""{PUMPS} SELECT pump, CASE WHEN least(start_detection_rate, end_detection_rate) >= 0.8 AND greatest(coalesce(avg_start_time_diff, 1e18), coalesce(avg_end_time_diff, 1e18)) <= 5 THEN 'good'
    WHEN least(start_detection_rate, end_detection_rate) >= 0.6 AND greatest(coalesce(avg_start_time_diff, 1e18), coalesce(avg_end_time_diff, 1e18)) <= 10 THEN 'fair' ELSE 'poor' END AS level,
    concat_ws('; ', CASE WHEN start_detection_rate < 0.8 THEN 'lower the start threshold' END, CASE WHEN end_detection_rate < 0.8 THEN 'lower the end threshold' END,
    CASE WHEN greatest(coalesce(avg_start_time_diff, 1e18), coalesce(avg_end_time_diff, 1e18)) > 5 THEN 'adjust the detection window' END, CASE WHEN avg_power_pattern_similarity < 0.7 THEN 'check the extracted power pattern' END) AS suggestions FROM pm""")
def verdict(spark, sf):
    return metrics.verdict(made_pumps(spark, sf)).select("pump", "level", "suggestions")


@query("WITH g AS (SELECT user_id AS device, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS gap FROM events) SELECT device, count(*) FILTER (gap > 1) + 1 AS levels FROM g GROUP BY device")
def pump_count_bound(spark, sf):
    return segments.pump_bound(readings(spark, sf), DEVICE, "x")


@query("SELECT event_type AS kind, min(value) AS low, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS q2, round(quantile_cont(value, 0.75), 4) AS q3, max(value) AS high FROM events GROUP BY 1")
def event_quartiles(spark, sf):
    return segments.quartiles(readings(spark, sf), ["kind"], "x").select("kind", "low", r4("q1"), r4("q2"), r4("q3"), "high")


POINTS = "p AS (SELECT vec_id AS id, label AS cluster, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS x3 FROM embeddings)"
APART = "(a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2 + (a.x3 - b.x3) ** 2"
CENTRE = "c AS (SELECT cluster, count(*) AS n, avg(x0) AS x0, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM p GROUP BY cluster)"


def points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(COORDINATES)))


@query(f"""WITH {POINTS}, d AS (SELECT a.id, a.cluster, b.cluster AS other, avg(sqrt({APART})) AS d FROM p a, p b WHERE a.id <> b.id GROUP BY 1, 2, 3),
    ab AS (SELECT id, cluster, max(d) FILTER (other = cluster) AS a, min(d) FILTER (other <> cluster) AS b FROM d GROUP BY 1, 2), s AS (SELECT cluster, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM ab),
    k AS (SELECT cluster, sum(s) AS t, count(*) AS n, stddev_pop(s) AS sd FROM s GROUP BY cluster) SELECT round(sum(t) / sum(n), 4) AS mean_silhouette, round(avg(sd), 4) AS spread, round(0.7 * sum(t) / sum(n) - 0.3 * avg(sd), 4) AS score FROM k""")
def silhouette_euclid(spark, sf):
    return clustering.silhouette_score(points(spark, sf), COORDINATES, (0.7, 0.3)).select(r4("mean_silhouette"), r4("spread"), r4("score"))


@query(f"""WITH {POINTS}, {CENTRE}, s AS (SELECT a.cluster, avg(sqrt({APART})) AS s FROM p a JOIN c b USING (cluster) GROUP BY 1), t AS (SELECT c.*, s.s FROM c JOIN s USING (cluster)),
    r AS (SELECT a.cluster, max((a.s + b.s) / nullif(sqrt({APART}), 0)) AS r FROM t a, t b WHERE a.cluster <> b.cluster GROUP BY 1) SELECT round(avg(r), 4) AS score FROM r""")
def davies_bouldin(spark, sf):
    return clustering.davies_bouldin(points(spark, sf), COORDINATES).select(r4("score"))


@query(f"""WITH {POINTS}, {CENTRE}, g AS (SELECT count(*) AS n, avg(x0) AS x0, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM p), bt AS (SELECT sum(a.n * ({APART})) AS v, count(*) AS k, max(b.n) AS n FROM c a, g b),
    w AS (SELECT sum({APART}) AS w FROM p a JOIN c b USING (cluster)) SELECT round(v / w * (n - k) / (k - 1), 4) AS score FROM bt, w""")
def calinski_harabasz(spark, sf):
    return clustering.calinski_harabasz(points(spark, sf), COORDINATES).select(r4("score"))


FIXED = [[0.1, 0.1, 0.0, 0.0], [-0.1, 0.0, 0.1, 0.0], [0.0, -0.1, 0.0, 0.1]]


@query(f"""WITH {POINTS}, b AS (SELECT * FROM (VALUES {", ".join(f"({k}, {', '.join(f'{v}::DOUBLE' for v in c)})" for k, c in enumerate(FIXED))}) v(k, x0, x1, x2, x3))
SELECT id, arg_min(k, struct_pack(d := {APART}, k := k)) AS cluster FROM p a, b GROUP BY id""")
def kmeans_assign(spark, sf):
    return clustering.assign(points(spark, sf).drop("cluster"), COORDINATES, FIXED).select("id", "cluster")


@query()
def kmeans_fit(spark, sf):
    return clustering.kmeans(points(spark, sf).drop("cluster"), COORDINATES, 5).select("id", "cluster")


@query()
def kmeans_search(spark, sf):
    labelled, score, k = clustering.search(points(spark, sf).drop("cluster"), COORDINATES)
    return labelled.select("id", "cluster", F.lit(score).alias("score"), F.lit(k).alias("k"))


@query()
def gmm_fit(spark, sf):
    labelled, score, k = mixture.gaussian_mixture(points(spark, sf).drop("cluster"), COORDINATES)
    return labelled.select("id", "cluster", F.lit(score).alias("score"), F.lit(k).alias("k"))


@query()
def pca_scores(spark, sf):
    return features.pca_scores(points(spark, sf), ["id"], COORDINATES, 2)


@query()
def two_stage_fit(spark, sf):
    labelled, _ = clustering.two_stage(points(spark, sf).drop("cluster"), COORDINATES[:2], COORDINATES[1:], 2, score="ch")
    return labelled.select("id", "stage1", "cluster")


@query()
def hac_fit(spark, sf):
    return clustering.ward(points(spark, sf).drop("cluster"), COORDINATES, 5).select("id", "cluster")


@query(f"""WITH RECURSIVE {POINTS}, near AS (SELECT a.id, b.id AS id2 FROM p a, p b WHERE {APART} <= 0.12::DOUBLE * 0.12::DOUBLE), cores AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 4),
    e AS (SELECT near.* FROM near WHERE id IN (SELECT id FROM cores) AND id2 IN (SELECT id FROM cores)), r AS (SELECT id, id AS root FROM cores UNION SELECT e.id2, r.root FROM r JOIN e ON e.id = r.id),
    l AS (SELECT id, min(root) AS cluster FROM r GROUP BY id) SELECT p.id, min(l.cluster) AS cluster FROM p LEFT JOIN near ON near.id = p.id LEFT JOIN l ON l.id = near.id2 GROUP BY p.id""")
def dbscan_fit(spark, sf):
    return clustering.dbscan(points(spark, sf).drop("cluster"), COORDINATES, 0.12, 4).select("id", "cluster")


@query()
def dbscan_search(spark, sf):
    labelled, score, found = clustering.density_search(points(spark, sf).drop("cluster"), COORDINATES)
    return labelled.select("id", "cluster", F.lit(score).alias("score"), F.lit(found[0]).alias("eps"), F.lit(found[1]).alias("min_samples"))


@query()
def optics_fit(spark, sf):
    return clustering.optics(points(spark, sf).drop("cluster"), COORDINATES, 0.03, 4).select("id", "cluster")


@query()
def optics_search(spark, sf):
    labelled, score, found = clustering.optics_search(points(spark, sf).drop("cluster"), COORDINATES, noise=True)
    return labelled.select("id", "cluster", F.lit(score).alias("score"), F.lit(found[0]).alias("xi"), F.lit(found[1]).alias("min_samples"))


CLASSES = "SELECT label AS class, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS x3 FROM embeddings WHERE label IS NOT NULL"


@query(f"""WITH v AS (UNPIVOT ({CLASSES}) ON x0, x1, x2, x3 INTO NAME name VALUE x), g AS (SELECT name, class, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM v GROUP BY 1, 2), w AS (SELECT name, avg(x) AS m FROM v GROUP BY 1)
SELECT name, sum(n * (g.m - w.m) ** 2) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS score FROM g JOIN w USING (name) GROUP BY name""")
def variance_ratios(spark, sf):
    return features.variance_ratios(points(spark, sf).withColumnRenamed("cluster", "class"), COORDINATES, "class")


@query()
def label_selectors(spark, sf):
    rows = points(spark, sf)
    found = [("kbest", c) for c in features.by_best(rows, COORDINATES, "cluster", 2)] + [("lasso", c) for c in features.by_lasso(rows, COORDINATES, "cluster", 0.01)]
    return spark.createDataFrame(found, "method string, name string")


#: Three phases made of the readings, with the estimated powers.
PHASED = """ev AS (SELECT user_id AS device, ts AS t, event_id, value AS x, value / 10 AS i, (1.5 + (event_id % 40) * 3 / 100) / 3 AS pf, 3 * ((value / 10 + value / 12) / 2) * 220 / 1000 AS base FROM events)"""


def phased(spark, sf):
    phases = {f"factor_{p}": 0.5 + (F.col("event_id") % 40) / 100 for p in "ABC"} | {f"volt_{p}": F.lit(220.0) for p in "ABC"}
    return pipeline.with_proxy(readings(spark, sf).withColumns(phases | {"curnt_B": F.col("x") / 10, "curnt_C": F.col("x") / 12}))


MEASURES = {"real": "realP_proxy", "reac": "reacP_proxy", "curnt": "curnt_B"}


def features_sql(column: str, name: str) -> str:
    return f"""stddev_pop({column}) FILTER (rn > 5) AS std_{name}, avg({column}) FILTER (rn > 5) AS ave_{name}, regr_slope({column}, date_diff('microsecond', t0, t) / 60e6) FILTER (rn > 5) AS trend_{name}, max({column}) FILTER (rn <= 5) AS max_{name}"""


@query(f"""WITH {PHASED}, {runs_sql(5)}, r AS (SELECT device, seg, t, row_number() OVER (PARTITION BY device, seg ORDER BY t, event_id) AS rn, pf * base AS a, sqrt(greatest(1 - pf * pf, 0)) * base AS b, i AS c FROM runs JOIN (SELECT event_id, i, pf, base FROM ev) USING (event_id)),
    s AS (SELECT *, min(t) FILTER (rn > 5) OVER (PARTITION BY device, seg) AS t0 FROM r)
SELECT device, seg, {features_sql("a", "real")}, {features_sql("b", "reac")}, {features_sql("c", "curnt")} FROM s GROUP BY device, seg HAVING count(*) FILTER (rn > 5) >= 10""")
def features12(spark, sf):
    return features.event_features(segments.runs(phased(spark, sf), DEVICE, "x", 5.0), DEVICE, MEASURES, "x")


def whole_minutes(rows):
    """Readings at the minute that they fall into: series by minute then meet the truth's minutes."""
    return rows.withColumn("t", F.date_trunc("minute", "t").cast("timestamp_ntz"))


def chain(rows):
    """Prepared events with labels by size of their mean, and their records."""
    ready = pipeline.prepared(rows, DEVICE, "x", MEASURES, 5.0, variance=20000.0)
    labels = ready.features.select("device", "seg", F.when(F.col("ave_real") < 3, 0).when(F.col("ave_real") < 5, 1).otherwise(2).alias("cluster"))
    return ready, *pipeline.records_of(ready, DEVICE, "x", labels, "ave_curnt")


#: The chain's events with their kinds, labels by size of the mono events' mean, and the records of both passes.
CHAIN = f"""WITH RECURSIVE {PHASED}, {segments_sql(5, 10)} {PULSES}, kinds AS (SELECT device, seg, variance < 20000 OR pulses = 1 AS is_mono FROM segs JOIN pulses USING (device, seg)),
    ready AS (SELECT runs.*, is_mono FROM runs JOIN kinds USING (device, seg)), others AS (SELECT * FROM ready WHERE NOT is_mono),
    r AS (SELECT device, seg, row_number() OVER (PARTITION BY device, seg ORDER BY ready.t, event_id) AS rn, pf * base AS a, i AS c FROM ready JOIN (SELECT event_id, i, pf, base FROM ev) USING (event_id) WHERE is_mono),
    f AS (SELECT avg(a) FILTER (rn > 5) AS ave_real, avg(c) FILTER (rn > 5) AS ave_curnt FROM r GROUP BY device, seg HAVING count(*) FILTER (rn > 5) >= 10),
    centres AS (SELECT CASE WHEN ave_real < 3 THEN 0 WHEN ave_real < 5 THEN 1 ELSE 2 END AS k, avg(ave_curnt) AS p FROM f GROUP BY 1),
    {deltas_sql("ready", "device, seg", 10, 1)}, {paired_sql("device, seg", 1)}, {deltas_sql("others", "device, seg", 3, 2)}, {paired_sql("device, seg", 2)}, {PASSES}"""


@query(f"{CHAIN} SELECT * FROM records")
def decomposed_chain(spark, sf):
    return chain(phased(spark, sf))[1]


def keyed_metrics_sql(key: str) -> str:
    """CTE `scores` (key and all metrics) from `j` (key, p, v)."""
    return f"""scores AS (SELECT {key}, 1 - coalesce(sum(v) FILTER (p < v), 0) / nullif(sum(v), 0) AS inclusion, (sum(v) - coalesce(sum(v) FILTER (p < v), 0)) / nullif(sum(p), 0) AS matching,
        1 - count(*) FILTER (p < v) / nullif(count(*) FILTER (v > 0), 0) AS time_inclusion, count(*) FILTER (p > 0 AND v > 0) / nullif(count(*) FILTER (p > 0 OR v > 0), 0) AS time_matching,
        least(count(*) FILTER (p > 0), count(*) FILTER (v > 0)) / nullif(count(*) FILTER (p > 0), 0) AS time_matching_ratio, sum(v) / nullif(sum(p), 0) AS information_ratio,
        avg(abs(p - v)) FILTER (v > 0) AS active_error, avg(abs(p - v)) FILTER (v <= 0) AS inactive_error, avg((p - v) * (p - v)) AS mse, avg(abs(p - v)) AS mae FROM j GROUP BY {key})"""


@query(f"""{CHAIN.replace("ts AS t", "date_trunc('minute', ts) AS t")}, e AS (SELECT "clusterId", min(starttime) AS a, max(endtime) AS b FROM records GROUP BY 1), g AS (SELECT "clusterId" AS cluster, unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS minute FROM e),
    pr AS (SELECT g.cluster, g.minute, count(starttime) * any_value(centres.p) AS p FROM g JOIN centres ON k = cluster LEFT JOIN records ON "clusterId" = cluster AND minute BETWEEN starttime AND endtime GROUP BY 1, 2),
    tr AS (SELECT date_trunc('minute', t) AS minute, avg(x) AS v FROM ev GROUP BY 1), a AS (SELECT cluster, minute FROM (SELECT DISTINCT cluster FROM pr), tr UNION SELECT cluster, minute FROM pr),
    j AS (SELECT a.cluster, coalesce(p, 0) AS p, v FROM a LEFT JOIN pr USING (cluster, minute) LEFT JOIN tr USING (minute)), {keyed_metrics_sql("cluster")} SELECT cluster, {", ".join(f"round({c}, 4) AS {c}" for c in NAMES)} FROM scores""")
def evaluated_chain(spark, sf):
    _, records, powers = chain(whole_minutes(phased(spark, sf)))
    return pipeline.evaluated(records, powers, minute_truth(spark, sf)).select("cluster", *(r4(c) for c in NAMES))


def minute_truth(spark, sf):
    return readings(spark, sf).groupBy(F.date_trunc("minute", "t").cast("timestamp_ntz").alias("minute")).agg(F.avg("x").alias("value"))


@query()
def auto_test(spark, sf):
    """From readings to scores with the clusters found by the k-means search."""
    scored = pipeline.auto_test(whole_minutes(phased(spark, sf)), DEVICE, "x", MEASURES, minute_truth(spark, sf), "ave_curnt", threshold=5.0, variance=20000.0)
    return scored.select("cluster", *(r4(c) for c in NAMES))


#: The readings of a kind as the prediction of a file; the truth: the mean of all readings of a minute, in whole hundredths.
FILES = f"""{GRID}, p AS (SELECT g.kind, g.g, ev.t AS t0, ev.x AS x0 FROM g ASOF LEFT JOIN ev ON g.kind = ev.kind AND g.g >= ev.t),
    q AS (SELECT p.*, ev.t AS t1, ev.x AS x1 FROM p ASOF LEFT JOIN ev ON p.kind = ev.kind AND p.g <= ev.t),
    pr AS (SELECT kind AS file, g AS minute, CASE WHEN t0 IS NULL OR (t1 IS NOT NULL AND t1 - g < g - t0) THEN x1 ELSE x0 END AS p FROM q),
    tr AS (SELECT date_trunc('minute', ts) AS minute, greatest(max(value) - 150, 0) AS v FROM events GROUP BY 1),
    a AS (SELECT file, minute FROM (SELECT DISTINCT file FROM pr), tr UNION SELECT file, minute FROM pr),
    j AS (SELECT a.file, coalesce(p, 0) AS p, v FROM a LEFT JOIN pr USING (file, minute) LEFT JOIN tr USING (minute)),
    {keyed_metrics_sql("file")}"""


@query(f"{FILES} SELECT file, {', '.join(f'round({c}, 4) AS {c}' for c in NAMES)} FROM scores")
def evaluated_files(spark, sf):
    rows = readings(spark, sf)
    pred = rows.select(F.col("kind").alias("file"), "t", F.col("x").alias("workingPower"))
    truth = rows.groupBy(F.date_trunc("minute", "t").cast("timestamp_ntz").alias("minute")).agg(F.greatest(F.max("x") - 150, F.lit(0.0)).alias("value"))
    return pipeline.evaluated_files(pred, truth).select("file", *(r4(c) for c in NAMES))


def report_sql() -> str:
    lines = [" SELECT series, 0 AS place, 'evaluation of ' || series AS line FROM m"]
    for k, (c, short, unit) in enumerate(metrics.REPORTED, 1):
        lines.append(f"SELECT series, {k}, coalesce(printf('  - {short}: %.3f{'%%' if unit else ''}', {c}::DOUBLE{' * 100' if unit else ''}), '  - {short}: none') FROM m")
    return METRICS + " UNION ALL ".join(lines)


@query(report_sql())
def evaluated_report(spark, sf):
    return metrics.report_lines(made_metrics(spark, sf), "series")


@query(f"""WITH {EV}, {runs_sql(20)}, g AS (SELECT device, seg, x - lag(x) OVER (PARTITION BY device, seg ORDER BY x) AS gap FROM runs), l AS (SELECT device, seg, count(*) FILTER (gap > 1) + 1 AS levels FROM g GROUP BY 1, 2) SELECT device, max(levels) AS levels FROM l GROUP BY device""")
def most_pumps(spark, sf):
    return segments.most_pumps(segments.runs(readings(spark, sf), DEVICE, "x", 20.0), EVENT, "x")


@query("""WITH c AS (SELECT a, b, c FROM range(4) x(a), range(4) y(b), range(4) z(c)), d AS (SELECT event_id, any_value(user_id) AS device, min(abs(a * 37.5 + b * 110.25 + c * 240.125 - value)) / nullif(abs(any_value(value)), 0) AS residual FROM events, c GROUP BY event_id)
SELECT device, avg(residual) AS residual FROM d GROUP BY device""")
def mean_residues(spark, sf):
    return blocks.mean_residues(readings(spark, sf), ["device"], "x", [37.5, 110.25, 240.125])


#: Twelve powers: 16,777,216 combinations of up to three pumps each.
TWELVE = [31.25 + 17.5 * k + k * k for k in range(12)]
SUMS = " CROSS JOIN ".join(f"(SELECT n * {p!r}::DOUBLE AS s{k} FROM range(4) r(n))" for k, p in enumerate(TWELVE))


@query(f"""WITH s AS (SELECT DISTINCT {" + ".join(f"s{k}" for k in range(12))} AS s FROM {SUMS}), v AS (SELECT event_id, value * 12 AS value FROM events), a AS (SELECT v.*, s.s AS lo FROM v ASOF LEFT JOIN s ON v.value >= s.s), b AS (SELECT a.*, s.s AS hi FROM a ASOF LEFT JOIN s ON a.value <= s.s)
SELECT event_id, round(least(coalesce(value - lo, 1e18), coalesce(hi - value, 1e18)) / nullif(abs(value), 0), 6) AS residual FROM b""")
def residual_twelve(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("value") * 12).alias("value"))
    return blocks.residual_combinations(rows, "value", TWELVE).select("event_id", (F.round("residual", 6) + 0.0).alias("residual"))
