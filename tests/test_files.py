"""Sources, sinks and streams on temporary files."""

import pytest
from pyspark.sql import functions as F

from quakeframe import bindings
from quakeframe.sources import files
from quakeframe.streaming import row_local

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("m") / "paths")
    d = bindings.view(spark, SF, "paths").withColumn("distance_km", F.lit(None).cast("double"))
    d.select(*[F.col(f.name).cast(f.dataType) for f in files.MEASUREMENTS.fields]).write.parquet(out)
    return out


def test_measurements(spark, paths):
    assert files.read_measurements(spark, paths, [5, 10], 3.0).filter("snr < 3 OR period_s > 10").count() == 0
    with pytest.raises(ValueError, match="99"):
        files.read_measurements(spark, paths, [5, 99])


def test_curve_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("# period value sigma\n10 3.2 0.1\n5 3.0 0.1\nbad line here\n7 nan 0.1\n8 3.1\n9 3 -1\n")
    curves, rejects = files.read_curve_files(spark, str(tmp_path / "*.dat"))
    assert [(r["period"], r["value"]) for r in curves.collect()] == [(5.0, 3.0), (10.0, 3.2)] and rejects.count() == 4


def test_dispersion_files(spark, tmp_path):
    d = spark.createDataFrame([(1, 5.0, 5.1, 3.0, 3.2, 1.5, 12.0), (1, 4.0, 4.1, 2.9, 3.1, 1.4, 11.0)], "trace_id int, target_period double, period double, group_velocity double, phase_velocity double, amplitude double, snr double")
    files.write_dispersion(d, str(tmp_path / "out"))
    (tmp_path / "out" / "trace_id=1" / "head.txt").write_text("# distance: 100\n# columns ... snr_db\n6 6 3 3 1 9\n")
    got = files.read_dispersion_files(spark, str(tmp_path / "out" / "trace_id=1" / "*.txt")).orderBy("target_period").collect()
    assert [r["target_period"] for r in got] == [4.0, 5.0, 6.0] and got[2]["header"]["distance"] == "100" and got[2]["decibel"]


def test_long_dispersion_files(spark, tmp_path):
    d = spark.createDataFrame([(1, 5.0, 5.1, 3.0, None, 1.5, 0.2, 0.3, 5.2, 12.0, "CI", 100), (2, 4.0, 4.1, 2.9, 3.1, 1.4, 0.1, 0.2, 4.3, 11.0, None, 50), (1, 4.0, 4.1, 2.8, 3.2, 1.4, 0.1, 0.2, 4.2, 10.0, "CI", 100)], "trace_id int, target_period double, period double, group_velocity double, phase_velocity double, amplitude double, phase_derivative double, hilbert_phase_derivative double, hilbert_period double, snr double, network string, distance int")
    out = tmp_path / "long"
    files.write_dispersion(d, str(out), debug=True, decibel=True, header=("network", "distance"))
    text = next((out / "trace_id=1").glob("*.txt")).read_text().splitlines()
    assert text[0] == "# network: CI" and text[1] == "# distance: 100" and text[2].endswith("instant_period_delta_s snr_db")
    assert text[3] == "    ".join(["4.000000", "4.100000", "2.8000", "3.2000", "1.400000e+00", "0.100000", "0.200000", "4.2000", "0.100000", "10.000"])
    assert next((out / "trace_id=2").glob("*.txt")).read_text().startswith("# distance: 50\n")
    got = files.read_dispersion_files(spark, str(out / "*" / "*.txt"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r["header"]["distance"], r["target_period"]): r for r in got.collect()}
    assert rows["100", 5.0]["snr"] == 12.0 and rows["100", 5.0]["phase_velocity"] is None and rows["50", 4.0]["hilbert_period"] == 4.3 and rows["50", 4.0]["decibel"]


def test_odd_dispersion_files(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "twice.txt").write_text("# a: 1\r\n# a: 2: 3\r\n\r\n4 4 3 x 1 9\r\n")
    (tmp_path / "bare.txt").write_text("5 5 3\n")
    got = {r["file"].rpartition("/")[2]: r for r in files.read_dispersion_files(spark, str(tmp_path / "*.txt")).collect()}
    assert set(got) == {"twice.txt", "bare.txt"} and got["twice.txt"]["header"] == {"a": "2: 3"} and got["twice.txt"]["phase_velocity"] is None and got["twice.txt"]["snr"] == 9.0
    assert got["bare.txt"]["header"] is None and got["bare.txt"]["decibel"] is None and got["bare.txt"]["snr"] is None


def test_fields_and_restack(spark, tmp_path):
    out = str(tmp_path / "fields")
    e = bindings.view(spark, SF, "event_cells")
    files.write_event_fields(e, out, provenance={"run": "t"})
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_event_fields(e, out)
    files.write_event_fields(e.filter("period_s = 5"), out, overwrite=True)
    assert spark.read.parquet(out).count() == e.count() - 0
    assert files.restack_from_fields(spark, out, [5, 10], min_raw_measurements_per_cell=2).select("period_s").distinct().count() == 2
    with pytest.raises(ValueError):
        files.restack_from_fields(spark, out, [5, 1000])
    with pytest.raises(ValueError):
        files.restack_from_fields(spark, out, [5], helmholtz=True)


def test_catalog_and_qc_table(spark, tmp_path):
    (tmp_path / "c.csv").write_text("time,latitude,longitude,depth,magnitude\n2020-01-01T00:00:00,1,2,10,5.5\n2020-01-02T00:00:00,1,2,10,6.5\n")
    assert [r["magnitude"] for r in files.read_event_catalog(spark, str(tmp_path / "c.csv")).collect()] == [6.5, 5.5]
    d = spark.createDataFrame([(1, 7, 30.12345, 1.7, 2.0, True), (1, 8, 31.0, 1.7, 2.0, False)], "station int, rf_id int, h double, k double, energy double, kept boolean")
    files.write_qc_table(d, str(tmp_path / "qc"))
    assert spark.read.csv(str(tmp_path / "qc"), header=True).first()["h"] == "30.1235"


def test_stream_equals_batch(spark, paths, tmp_path):
    q = row_local.write_travel_times(spark, paths, str(tmp_path / "o"), str(tmp_path / "c"), 3.0)
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == row_local.with_travel_times(spark.read.parquet(paths), 3.0).count()


def test_qc_table_rounds_the_doubles(spark):
    from quakeframe.plans.tables import _s8

    d = spark.createDataFrame([(1, 0, 30 + 256125.0 / 25000, 1.5, 2.0), (2, 0, 37.125, 1.5, 2.0)], "rf_id int, station int, h double, k double, energy double")
    assert {r["name"]: r["h"] for r in _s8(d).collect()} == {"1": "40.2400", "2": "37.1300"}
