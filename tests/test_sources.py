import datetime as dt

import pytest

from wattloom.plans import pipeline
from wattloom.sources import meter


def meter_file(path, times, value="1000"):
    rows = [",".join(["h"] * 33)]
    for t in times:
        rows.append(",".join([t, *["220"] * 6, *["10"] * 3, *[value] * 12, *["-0.8"] * 4, *["1"] * 7]))
    path.write_text("\n".join(rows) + "\n")


def test_meter_files(spark, tmp_path):
    meter_file(tmp_path / "Well-35-139091-values.csv", ["2017-11-01 00:05:00", "2017-11-01 00:00:00", "2017-11-01 00:05:00"])
    meter_file(tmp_path / "Well-36-1.csv", ["11.1.2017 0:10", "11.1.2017 0:15"], "NaN")
    rows = meter.read_meter(spark, str(tmp_path)).orderBy("device", "T").collect()
    assert [(r["device"], r["T"]) for r in rows] == [("Well-35", dt.datetime(2017, 11, 1)), ("Well-35", dt.datetime(2017, 11, 1, 0, 5)), ("Well-36", dt.datetime(2017, 11, 1, 0, 10)), ("Well-36", dt.datetime(2017, 11, 1, 0, 15))]
    assert rows[0]["realP_A"] == 1 and rows[0]["factor_tot"] == 0.8 and rows[2]["realP_A"] is None and len(rows[0]) == 27


def test_a_device_with_files_of_two_formats(spark, tmp_path):
    meter_file(tmp_path / "a-b-1.csv", ["2017-11-01 00:00:00", "2017-11-01 00:05:00", "2017-11-01 00:10:00"])
    meter_file(tmp_path / "a-b-2.csv", ["11.1.2017 0:15", "11.1.2017 0:20", "11.1.2017 0:25", "11.1.2017 0:30"])
    rows = meter.read_meter(spark, str(tmp_path)).orderBy("T").collect()
    assert [r["T"].minute for r in rows] == [0, 5, 10, 15, 20, 25, 30] and {r["device"] for r in rows} == {"a-b"}


def test_the_first_file_wins_and_unfit_times_raise(spark, tmp_path):
    meter_file(tmp_path / "a-b-1.csv", ["2017-11-01 00:00:00"], "1000")
    meter_file(tmp_path / "a-b-2.csv", ["11.1.2017 0:00"], "5000")
    assert [r["realP_A"] for r in meter.read_meter(spark, str(tmp_path)).collect()] == [1]
    meter_file(tmp_path / "a-b-3.csv", ["11.1.2017 0:00", "2017-11-01 00:00:00"])
    with pytest.raises(Exception, match="does not fit"):
        meter.read_meter(spark, str(tmp_path)).collect()


def test_a_folder_of_predictions_in_one_job(spark, tmp_path):
    for name, values in (("x.csv", (1.0, 2.0, 0.0)), ("y.csv", (0.0, 0.0, 4.0)), ("y_error.csv", (9.0, 9.0, 9.0))):
        (tmp_path / name).write_text(",UTC Time,workingPower\n" + "".join(f"{k},2024-01-01 00:0{k + 1}:00,{v}\n" for k, v in enumerate(values)))
    truth = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), v) for m, v in ((0, 3.0), (1, 1.0), (2, 0.0), (4, 2.0))], "minute timestamp_ntz, value double")
    got = {r["file"]: r for r in pipeline.evaluated_files(meter.read_predictions(spark, str(tmp_path)), truth).collect()}
    assert set(got) == {"x.csv", "y.csv"}
    x, y = got["x.csv"], got["y.csv"]  # minutes 0, 1, 2, 4 of the truth; 3 has no truth
    assert (x["mae"], y["mae"], x["mse"]) == ((3 + 0 + 2 + 2) / 4, (3 + 1 + 0 + 2) / 4, (9 + 0 + 4 + 4) / 4)
    assert (x["inclusion"], x["time_inclusion"], x["time_matching"], y["time_matching"]) == (1 - 5 / 6, 1 - 2 / 3, 1 / 4, 0 / 4)
    assert (x["active_error"], x["inactive_error"], y["information_ratio"]) == (5 / 3, 2.0, 6 / 4)


def test_unknown_format_raises(spark, tmp_path):
    meter_file(tmp_path / "a-b.csv", ["1st of May"])
    with pytest.raises(Exception, match="unknown time format"):
        meter.read_meter(spark, str(tmp_path)).collect()


def test_counter_needs_its_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text("UTC Time,Cum. Quant\n31.12.17 23:55,5.5\n01.01.2018 00:00,6\n")
    rows = meter.read_counter(spark, str(tmp_path / "c.csv")).orderBy("t").collect()
    assert [(r["t"], r["cum_quant"]) for r in rows] == [(dt.datetime(2017, 12, 31, 23, 55), 5.5), (dt.datetime(2018, 1, 1), 6.0)]
    (tmp_path / "d.csv").write_text("UTC Time,x\n31.12.17 23:55,5.5\n")
    with pytest.raises(ValueError, match="Cum. Quant"):
        meter.read_counter(spark, str(tmp_path / "d.csv"))


def test_predictions_without_the_files_of_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",UTC Time,workingPower\n0,2024-01-01 00:00:00,1.5\n")
    (tmp_path / "a_error.csv").write_text(",UTC Time,workingPower\n0,2024-01-01 00:00:00,9.5\n")
    assert [tuple(r) for r in meter.read_prediction(spark, str(tmp_path)).collect()] == [(dt.datetime(2024, 1, 1), 1.5)]


def test_series_lie_by_cluster(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    meter.write_series(spark.createDataFrame([(0, t, 1.0), (1, t, 2.0)], "cluster int, minute timestamp_ntz, signal double"), str(tmp_path / "s"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "s"))
    assert sorted((r["cluster"], r["signal"]) for r in back.collect()) == [(0, 1.0), (1, 2.0)]


def test_truth_is_numbered_over_ranges(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    times = [t + dt.timedelta(minutes=(37 * k) % 101) for k in range(101)]
    meter.write_truth(spark.createDataFrame([(x, x) for x in times], "starttime timestamp_ntz, endtime timestamp_ntz").repartition(7), str(tmp_path / "t"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "t")).collect()
    assert [r["starttime"] for r in sorted(rows, key=lambda r: int(r["recordId"]))] == [f"{x:%Y-%m-%d %H:%M:%S}" for x in sorted(times)]
    assert sorted(int(r["recordId"]) for r in rows) == list(range(1, 102))


def test_events_round_trip(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 0, 3, t, t, 0), (2, 1, 3, t, t, 1)], meter.EVENT_SCHEMA)
    meter.write_events(df, str(tmp_path / "e"))
    assert sorted(meter.read_events(spark, str(tmp_path / "e")).collect()) == sorted(df.collect())
    meter.write_events(df, str(tmp_path / "by"), by_cluster=True)
    assert sorted(p.name for p in (tmp_path / "by").glob("clusterId=*")) == ["clusterId=0", "clusterId=1"]
    back = spark.read.option("header", True).csv(str(tmp_path / "by"))
    assert sorted((int(r["recordId"]), int(r["clusterId"])) for r in back.collect()) == [(1, 0), (2, 1)]
    meter.write_truth(df.select("starttime", "endtime"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["recordId", "starttime", "endtime"]
