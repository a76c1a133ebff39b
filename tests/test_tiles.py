"""Storms found in tiles of a grid are those found in the whole grid."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.operators import detect


def _field(seed: int, low: float = -90.0, high: float = 90.0, west: float = 0.0, east: float = 360.0, step: float = 3.0, storms: int = 40) -> pd.DataFrame:
    """Storms at random places, some near the poles, the date line and each other, on
    rough ground."""
    rng = np.random.default_rng(seed)
    lat, lon = np.arange(low, high + 1e-9, step), np.arange(west, east - 1e-9, step)
    a, b = np.meshgrid(lat, lon, indexing="ij")
    psl, thick, wind = 101000 + 40 * rng.random(a.shape), 4000 + rng.random(a.shape), 10 * rng.random(a.shape)
    for k in range(storms):
        y, x = rng.uniform(low, high), (0.5 if k % 4 == 0 else rng.uniform(west, east))
        d = detect._degrees(y, x, a, b)
        psl -= rng.uniform(500, 3000) * np.exp(-((d / rng.uniform(2, 4)) ** 2))
        thick += rng.uniform(0, 40) * np.exp(-((d / 4) ** 2))
        wind += 30 * np.exp(-(((d - 2) / 2) ** 2))
    return pd.DataFrame({"lat": a.ravel(), "lon": b.ravel(), "psl": psl.ravel(), "thickness": thick.ravel(), "wind": wind.ravel()})


def _rows(df) -> list[tuple]:
    return sorted(map(tuple, df.select("step", "lat", "lon", "psl", "wind").collect()))


@pytest.fixture(scope="module")
def fields(spark):
    parts = [_field(k).assign(step=k) for k in range(3)]
    return spark.createDataFrame(pd.concat(parts)).cache()


@pytest.fixture(scope="module")
def whole(fields):
    found = _rows(detect.detect_nodes(fields, ["step"]))
    assert len(found) > 30 and any(abs(r[1]) > 75 for r in found) and any(r[2] == 0 for r in found)
    return found


@pytest.mark.parametrize("tile", [7.0, 20.0, 30.0, 45.0, 90.0, 180.0])
def test_tiles_change_nothing(fields, whole, tile):
    assert _rows(detect.detect_nodes(fields, ["step"], tile=tile, step=3.0)) == whole


@pytest.mark.parametrize("west", [-180.0, 30.0])
def test_other_longitudes(spark, west):
    """Longitudes from -180 on, and a grid that doesn't go round."""
    pdf = _field(9, -60, 60, west, 180.0 if west < 0 else 200.0).assign(step=0)
    f = spark.createDataFrame(pdf)
    found = _rows(detect.detect_nodes(f, ["step"]))
    assert len(found) > 5
    for tile in (15.0, 40.0):
        assert _rows(detect.detect_nodes(f, ["step"], tile=tile, step=3.0)) == found


def test_every_place_has_one_tile(spark):
    for size, halo in ((7.0, 13.0), (30.0, 10.0), (45.0, 2.0), (200.0, 5.0)):
        tiles = detect.Tiles(size, halo)
        places = spark.range(5000).select("id", (F.col("id") * 37 % 1801 / 10 - 90).alias("lat"), (F.col("id") * 101 % 7200 / 10 - 360).alias("lon"))
        seen = places.select("id", F.explode(tiles.seen()).alias("at"))
        own = seen.where("at.own").groupBy("id").count()
        assert own.count() == 5000 and own.where("count <> 1").count() == 0
        assert seen.groupBy("id", "at.band", "at.tile").count().where("count > 1").count() == 0


def test_halo_holds_what_is_near():
    """A place within the halo of a tile's own place is seen by the tile."""
    rng = np.random.default_rng(4)
    for size, halo in ((10.0, 12.0), (30.0, 10.0), (60.0, 20.0)):
        tiles = detect.Tiles(size, halo)
        for _ in range(4000):
            lat, lon = rng.uniform(-90, 90), rng.uniform(0, 360)
            band = min(tiles.bands - 1, int((lat + 90) / size))
            n = tiles.count(band)
            if n == 1:
                continue
            at = min(n - 1, int(lon / (360 / n)))
            y = min(90.0, max(-90.0, lat + rng.uniform(-halo, halo)))
            x = lon + rng.uniform(-180, 180)
            if detect._degrees(lat, lon, y, x) <= halo:
                off = abs((x - (at + 0.5) * 360 / n + 180) % 360 - 180)
                assert off <= 180 / n + tiles._half(band) + 1e-6


def test_missing_and_empty(spark, fields):
    schema = "step int, lat double, lon double, psl double, thickness double, wind double"
    for tile in (None, 30.0):
        assert detect.detect_nodes(spark.createDataFrame([], schema), ["step"], tile=tile).count() == 0
    holes = fields.withColumns({"psl": F.when(F.col("lat") % 2 == 0, F.col("psl")), "own": F.lit("clash"), "band": F.lit(1)})
    assert _rows(detect.detect_nodes(holes, ["step"], tile=30.0, step=3.0)) == _rows(detect.detect_nodes(holes, ["step"]))
    none = fields.withColumn("psl", F.lit(None).cast("double"))
    assert detect.detect_nodes(none, ["step"], tile=30.0, step=3.0).count() == 0


def test_steps_beyond_what_was_said(fields):
    with pytest.raises(Exception, match="steps are over"):
        detect.detect_nodes(fields, ["step"], tile=30.0, step=1.0).count()


def test_equal_depths_are_settled(spark):
    """Two equal lows in reach of each other: the southern one stays, in any tiles."""
    lat, lon = np.meshgrid(np.arange(-20.0, 21), np.arange(0.0, 40), indexing="ij")
    depth = np.zeros(lat.shape)
    for y, x in ((-2, 15), (2, 15)):
        depth = np.maximum(depth, 1000 * np.exp(-((lat - y) ** 2 + (lon - x) ** 2) / 2))
    pdf = pd.DataFrame({"step": 0, "lat": lat.ravel(), "lon": lon.ravel(), "psl": (101000 - depth).ravel(), "thickness": (4000 + depth / 20).ravel(), "wind": 1.0})
    for tile in (None, 8.0, 30.0):
        found = _rows(detect.detect_nodes(spark.createDataFrame(pdf), ["step"], tile=tile, step=1.0))
        assert [(r[1], r[2]) for r in found] == [(-2.0, 15.0)]
    assert math.isclose(found[0][3], 100000)
