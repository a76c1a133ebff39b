"""NetCDF files of all versions: equal cubes, what is read of them, and what is written."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, StringContains

from isobar.sources import netcdf
from isobar.sources.netcdf import Reader, read_netcdf

from .hdf5_files import netcdf4

TIME, LAT, LON = np.arange(0.0, 30.0), np.linspace(-75, 75, 11), np.arange(0.0, 360, 30)
FILL = -99.0


def field():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 11, 12)).astype("<f4")
    x[rng.random(x.shape) < 0.1] = FILL
    return x


def classic(path, x, record):
    """Version 2, time fixed or of records, beside another variable of records."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    attr = struct.pack(">ii", 12, 1) + name("_FillValue") + struct.pack(">ii", 5, 1) + struct.pack(">f", FILL)
    none = struct.pack(">ii", 0, 0)
    n = len(x)
    dims = struct.pack(">ii", 10, 3) + b"".join(name(d) + struct.pack(">i", k) for d, k in (("time", 0 if record else n), ("lat", 11), ("lon", 12)))
    row = x[0].size * 4

    def header(at):
        ends = np.cumsum([at, 11 * 8, 12 * 8, 8 if record else n * 8])
        out = b"CDF\x02" + struct.pack(">i", n if record else 0) + dims + none + struct.pack(">ii", 11, 4)
        for k, (v, own) in enumerate((("lat", [1]), ("lon", [2]), ("time", [0]), ("tas", [0, 1, 2]))):
            size = {"lat": 88, "lon": 96, "time": 8 if record else n * 8, "tas": row if record else row * n}[v]
            out += name(v) + struct.pack(">i", len(own)) + struct.pack(f">{len(own)}i", *own) + (attr if v == "tas" else none) + struct.pack(">iiq", 5 if v == "tas" else 6, size, ends[k])
        return out

    body = header(len(header(0))) + LAT.astype(">f8").tobytes() + LON.astype(">f8").tobytes()
    big = x.astype(">f4")
    path.write_bytes(body + (b"".join(struct.pack(">d", t) + v.tobytes() for t, v in zip(TIME, big, strict=True)) if record else TIME.astype(">f8").tobytes() + big.tobytes()))


KINDS = ["classic", "records", "old", "new"]


@pytest.fixture(scope="module", params=KINDS)
def file(request, tmp_path_factory):
    path, x = tmp_path_factory.mktemp(request.param) / "tas.nc4", field()
    if request.param in ("classic", "records"):
        classic(path, x, request.param == "records")
    else:
        more = {"_FillValue": np.array([FILL], "<f4"), "units": "K", "long_name": "air temperature " * 12, "cell_methods": "time: mean", "standard_name": "air_temperature " * 9, "a": "x" * 300}
        netcdf4(path, {"time": TIME, "lat": LAT, "lon": LON}, "tas", x, (7, 5, 12), request.param == "new", skip={(7, 0, 0)}, attributes=more)
        x[7:14, :5] = FILL
    return str(path), np.where(x == FILL, np.nan, x.astype(float))


def as_array(rows):
    out = np.full((30, 11, 12), np.inf)
    for t, la, lo, v in rows:
        at = int(t), int(np.abs(LAT - la).argmin()), int(lo / 30)
        assert out[at] == np.inf and abs(LAT[at[1]] - la) < 1e-9
        out[at] = np.nan if v is None else v
    return out


def test_cubes_are_equal(spark, file):
    path, x = file
    got = read_netcdf(spark, path, "tas")
    assert got.columns == ["time", "lat", "lon", "value"]
    np.testing.assert_array_equal(as_array(got.collect()), x)


def test_attributes(file):
    path, _ = file
    assert float(np.ravel(netcdf.describe(path, "tas")["_FillValue"])[0]) == FILL
    if "old" in path or "new" in path:
        assert netcdf.describe(path, "tas")["cell_methods"] == "time: mean" and netcdf.describe(path, "tas")["long_name"].startswith("air")
        assert netcdf.describe(path, "time")["units"] == "days since 2000-01-01"


def test_filters_are_pushed(spark, file):
    path, x = file
    got = read_netcdf(spark, path, "tas").where("time >= 5 AND time < 9 AND lat IN (-75.0, 75.0) AND lon = 60 AND value > 0")
    want = [(t, la, 60.0) for t in range(5, 9) for la, k in ((-75.0, 0), (75.0, 10)) if x[t, k, 2] > 0]
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted(want)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in text.split("BatchScan")[0] and "time" not in text.split("BatchScan")[0].split("Filter")[1].split("\n")[0]
    assert read_netcdf(spark, path, "tas").where("lat > 80").count() == 0
    assert read_netcdf(spark, path, "tas").where("lat > 80 OR lon < 45").count() == 30 * 11 * 2


class Counted:
    def __init__(self, f, taken):
        self.f, self.taken = f, taken

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.f.close()

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        self.taken.append(n)
        return self.f.read(n)


def test_only_what_is_asked_for_is_read(file, monkeypatch):
    path, x = file
    taken, plain = [], open
    monkeypatch.setattr(netcdf, "_open", lambda p: Counted(plain(p, "rb"), taken))
    monkeypatch.setattr(netcdf, "CELLS", 800)

    def read(filters):
        made = Reader(path, "tas")
        left = list(made.pushFilters(filters))
        rows, most = [], 0
        for part in made.partitions():
            taken.clear()
            for batch in made.read(part):
                rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            most = max(most, sum(taken))
        taken.clear()
        for part in made.partitions():
            list(made.read(part))
        return rows, left, sum(taken), most

    every, _, whole, most = read([])
    np.testing.assert_array_equal(as_array(every), x)
    assert most < whole / 2
    odd = StringContains(("lat",), "x")
    some, left, less, _ = read([GreaterThanOrEqual(("time",), 20), LessThan(("time",), 21.5), EqualTo(("lat",), 0.0), IsNotNull(("lat",)), odd])
    assert left == [odd] and {r[:2] for r in some} == {(20.0, 0.0), (21.0, 0.0)} and len(some) == 24
    assert less < whole / 2
    rows, *_ = read([In(("lon",), (0, 330, 5)), EqualTo(("time",), 29)])
    assert {r[2] for r in rows} == {0.0, 330.0} and len(rows) == 22


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a classic"):
        read_netcdf(spark, str(tmp_path / "x.nc"), "tas")
    with pytest.raises(NotImplementedError):
        read_netcdf(spark, "x.grib", "tas")


def bundle(spark):
    cells = [(float(t), float(la), float(lo), t * 100.0 + la + lo / 1000) for t in range(50) for la in (-45, 0, 45) for lo in range(0, 360, 30) if (t + lo) % 7]
    cells[3] = (*cells[3][:3], None)
    cells[4] = (*cells[4][:3], float("nan"))
    cube = spark.createDataFrame(cells, "time double, lat double, lon double, value double").repartition(5)
    mean = cube.groupBy("time").agg(F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("value"))
    return cells, cube, mean


def test_what_is_written_is_read(spark, tmp_path):
    from isobar.sources import netcdf_sink as sink

    cells, cube, mean = bundle(spark)
    path = str(tmp_path / "out.nc")
    sink.write_netcdf({"tas": sink.Table(cube, ("time", "lat", "lon"), {"units": "K", "scale": 2.0}), "mean": sink.Table(mean, ("time",))}, path, {"title": "both"})
    got = {(r[0], r[1], r[2]): r[3] for r in read_netcdf(spark, path, "tas").collect()}
    assert len(got) == 50 * 3 * 12
    want = {c[:3]: None if c[3] is None or c[3] != c[3] else c[3] for c in cells}
    assert all(got[k] == want.get(k) for k in got) and want.keys() <= got.keys()
    assert sorted(map(tuple, read_netcdf(spark, path, "mean").collect())) == sorted((r["time"], r["value"]) for r in mean.collect())
    assert netcdf.describe(path, "tas")["units"] == "K" and [p.name for p in tmp_path.iterdir()] == ["out.nc"]
    assert read_netcdf(spark, path, "tas").where("time = 49 AND lat > 0").count() == 12
    with pytest.raises(FileExistsError):
        sink.write_netcdf({"mean": sink.Table(mean, ("time",))}, path)
    sink.write_netcdf({"mean": sink.Table(mean.where("time < 3"), ("time",))}, path, overwrite=True)
    assert read_netcdf(spark, path, "mean").count() == 3


def test_times_become_days(spark, tmp_path):
    from isobar.functions.calendars import decoded
    from isobar.sources import netcdf_sink as sink

    days = spark.sql("SELECT timestamp_ntz'2001-03-01 06:00:00' + make_dt_interval(id) AS time, cast(id AS double) AS value FROM range(40)")
    path = str(tmp_path / "days.nc")
    sink.write_netcdf({"x": sink.Table(days, ("time",))}, path)
    about = netcdf.describe(path, "time")
    got = read_netcdf(spark, path, "x").select(decoded(F.col("time"), about["units"], about["calendar"])["time"].alias("time"), "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, days.collect()))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from isobar.sources import netcdf_sink as sink

    _, cube, mean = bundle(spark)
    kept = tmp_path / "kept.nc"
    sink.write_netcdf({"mean": sink.Table(mean, ("time",))}, str(kept))
    before = kept.read_bytes()
    broken = cube.withColumn("value", F.when(F.col("time") == 49, F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    for rows, said in ((broken, "broken"), (cube.union(cube.where("time = 49")), "one cell")):
        with pytest.raises(Exception, match=said):
            sink.write_netcdf({"tas": sink.Table(rows, ("time", "lat", "lon"))}, str(kept), overwrite=True)
        assert [p.name for p in tmp_path.iterdir()] == ["kept.nc"] and kept.read_bytes() == before
    made = sink.Writer({"part": str(tmp_path / "p"), "path": str(tmp_path / "q"), "begins": "[0]", "cells": "[1]", "blocks": "2"})
    (tmp_path / "p").write_bytes(b"x")
    with pytest.raises(OSError, match="1 of 2"):
        made.commit([sink.Done(1), None])
    assert [p.name for p in tmp_path.iterdir()] == ["kept.nc"]
    with pytest.raises(NotImplementedError):
        sink.write_netcdf({"mean": sink.Table(mean, ("time",))}, "s3://bucket/x.nc")


def test_blocks_of_a_task(tmp_path):
    """Blocks over several batches, of two variables, and cells without rows."""
    import os

    import pyarrow as pa

    from isobar.sources import netcdf_sink as sink

    size = sink.BLOCK
    part = tmp_path / "part"
    part.write_bytes(b"\0" * ((2 * size + 5) * 8))
    made = sink.Writer({"part": str(part), "path": str(tmp_path / "x"), "begins": json_list(0, (size + 3) * 8), "cells": json_list(size + 3, size + 2), "blocks": "4"})
    rows = [(0, 0, None, False), (0, 5, 1.5, True), (0, size - 1, 2.5, True), (0, size, None, False), (0, size + 2, 3.5, True), (1, 0, None, False), (1, 0, 4.5, True), (1, size, None, False)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 3], strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["v", "at", "value", "real"]) for k in (0, 3, 6)]
    assert made.write(iter(batches)).blocks == 4
    x = np.frombuffer(part.read_bytes(), ">f8")
    fill = netcdf.FILL[sink.DOUBLE]
    want = np.full(2 * size + 5, fill)
    want[[5, size - 1, size + 2, size + 3]] = [1.5, 2.5, 3.5, 4.5]
    np.testing.assert_array_equal(x, want)
    made.commit([sink.Done(4)])
    assert os.listdir(tmp_path) == ["x"]


def json_list(*numbers):
    return "[" + ",".join(map(str, numbers)) + "]"
