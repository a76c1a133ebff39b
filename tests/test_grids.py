"""Whole grids as rows: searched where they are, with the nodes of their cells."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.operators import detect
from isobar.plans import bindings, more_queries

from .conftest import DATA
from .test_tiles import _field, _rows

VALUES = ["psl", "thickness", "wind"]


def _pack(cells: pd.DataFrame) -> dict:
    """One grid of cells as a row, latitudes from the north and longitudes as they come."""
    by = {v: cells.pivot(index="lat", columns="lon", values=v).iloc[::-1] for v in VALUES}
    return {"lat": by["psl"].index.tolist(), "lon": by["psl"].columns.tolist(), **{v: [None if pd.isna(x) else float(x) for x in g.to_numpy().ravel()] for v, g in by.items()}}


SCHEMA = "step int, lat array<double>, lon array<double>, psl array<double>, thickness array<double>, wind array<double>"


@pytest.fixture(scope="module")
def both(spark):
    """Cells, and the same as grids: the round sphere twice with one storm beside another, a
    part of it, one with missing values, and finer ones."""
    parts = [_field(1), _field(2), _field(3, -60, 60, 30.0, 200.0), _field(4, storms=90), _field(5, -30, 45, 300.0, 355.0, 1.5, 12), _field(6, step=5.0)]
    parts[3].loc[parts[3].index % 17 == 0, "psl"] = float("nan")
    parts[3].loc[parts[3].index % 13 == 0, "thickness"] = float("nan")
    parts[3].loc[parts[3]["lat"] > 20, "wind"] = float("nan")
    cells = spark.createDataFrame(pd.concat([p.assign(step=k) for k, p in enumerate(parts)]))
    cells = cells.withColumns({v: F.when(~F.isnan(v), F.col(v)) for v in VALUES})
    grids = spark.createDataFrame([(k, *_pack(p).values()) for k, p in enumerate(parts)], SCHEMA)
    return cells.cache(), grids.cache()


def _ordered(df) -> list[tuple]:
    return sorted(map(tuple, df.select("step", "lat", "lon", "psl", "wind").collect()), key=repr)


def test_grids_have_the_nodes_of_their_cells(both):
    cells, grids = both
    want = _ordered(detect.detect_nodes(cells, ["step"]))
    assert {r[0] for r in want} == set(range(6)) and any(r[4] is None for r in want)
    assert _ordered(detect.detect_nodes(grids, ["step"])) == want
    assert _ordered(detect.detect_nodes(grids, ["step"], tile=30.0, step=5.0)) == want
    assert _ordered(detect.places(grids, ["step"], VALUES)) == _ordered(cells.select("step", "lat", "lon", *VALUES))


def test_nodes_are_where_a_plain_search_finds_them(both):
    """Every way out, cell by cell, as the criteria say."""
    cells, grids = both
    got = {r[:3] for r in _ordered(detect.detect_nodes(grids.where("step = 5"), ["step"]))}
    own = cells.where("step = 5").toPandas()
    lat, lon = sorted(own["lat"].unique()), sorted(own["lon"].unique())
    at = {(r.lat, r.lon): r for r in own.itertuples()}

    def beside(y, x, corners):
        i, j = lat.index(y), lon.index(x)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                if (a, b) != (0, 0) and (corners or 0 in (a, b)) and 0 <= i + a < len(lat):
                    yield lat[i + a], lon[(j + b) % len(lon)]

    def shut(v, y, x, delta, far):
        sign = 1 if delta > 0 else -1
        level, seen, todo = sign * getattr(at[y, x], v) + abs(delta), {(y, x)}, [(y, x)]
        while todo:
            for c in beside(*todo.pop(), False):
                if c not in seen and sign * getattr(at[c], v) < level:
                    if detect._degrees(y, x, *c) > far:
                        return False
                    seen.add(c)
                    todo.append(c)
        return True

    want = []
    for (y, x), r in at.items():
        if all(r.psl < at[c].psl for c in beside(y, x, True)) and shut("psl", y, x, 200.0, 5.5):
            near = [(-r2.thickness, c) for c, r2 in at.items() if detect._degrees(y, x, *c) <= 1.0]
            if shut("thickness", *min(near)[1], -6.0, 6.5):
                want.append((r.psl, y, x))
    kept = []
    for _, y, x in sorted(want):
        if all(detect._degrees(y, x, b, c) > 6.0 for _, b, c in kept):
            kept.append((5, y, x))
    assert got == set(kept) and len(got) > 5


def test_odd_grids(spark):
    """Null axes, empty axes and null fields have no nodes, a null wind is null, and values
    have to fit."""
    cells = _field(8, -30, 30, 100.0, 160.0)
    row = _pack(cells)
    without = lambda **new: tuple((row | new).values())
    rows = [(0, *without()), (1, *without(lat=None)), (2, *without(lat=[], psl=[], thickness=[], wind=[])), (3, *without(psl=None)), (4, *without(thickness=None)), (5, *without(wind=None))]
    found = _ordered(detect.detect_nodes(spark.createDataFrame(rows, SCHEMA), ["step"]))
    whole = [r[1:] for r in found if r[0] == 0]
    assert len(whole) > 2 and {r[0] for r in found} == {0, 5}
    assert [(*r[:3], None) for r in whole] == [r[1:] for r in found if r[0] == 5]
    assert _ordered(detect.detect_nodes(spark.createDataFrame([(0, *without())], SCHEMA), ["step"], tile=20.0, step=3.0)) == [(0, *r) for r in whole]
    assert detect.detect_nodes(spark.createDataFrame([], SCHEMA), ["step"]).count() == 0
    with pytest.raises(Exception, match="other than"):
        detect.detect_nodes(spark.createDataFrame([(0, *without(psl=row["psl"][1:]))], SCHEMA), ["step"]).count()


def test_searching_grids_shuffles_nothing(both):
    _, grids = both
    for fields in (grids, detect.Reading(grids, iter)):
        assert "Exchange" not in detect.detect_nodes(fields, ["step"])._jdf.queryExecution().toString()


def test_grids_that_are_read_where_they_are_searched(both):
    """A reading gives what its grids as rows give, with tiles and without, of any rows."""
    _, grids = both
    rows = grids.select("step", F.col("lat").alias("y"), F.col("lon").alias("x"), *[F.col(v).alias(f"_{v}") for v in VALUES])

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.slice(k, 1).rename_columns(["step", "lat", "lon", *VALUES])

    reading = detect.Reading(rows, lambda batches: (b.append_column("y", b["lat"]).append_column("x", b["lon"]) for b in read(batches)))
    want = _ordered(detect.detect_nodes(grids, ["step"]))
    assert _ordered(detect.detect_nodes(reading, ["step"])) == want
    assert _ordered(detect.detect_nodes(reading.over(lambda r: r.where("step > 2")), ["step"])) == [r for r in want if r[0] > 2]
    kept = detect.Reading(grids.select("step", F.struct(*grids.columns[1:]).alias("of")), _unpacked)
    assert _ordered(detect.detect_nodes(kept, ["step"], tile=30.0, step=5.0)) == want


def _unpacked(batches):
    for batch in batches:
        for k, of in enumerate(batch.schema.field("of").type):
            batch = batch.append_column(of.name, batch["of"].field(k))
        yield batch


def test_fields_are_spread_over_tasks(spark):
    """Suppliers come as one small file; their grids don't stay in one task."""
    fields = bindings.storm_fields(spark, f"{DATA}/sf0.01").rows
    assert fields.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    rows = spark.range(60_000).withColumnRenamed("id", "s")
    assert bindings.dealt(rows, "s").rdd.getNumPartitions() == 120 and bindings.dealt(rows, "s").count() == 60_000


def test_nodes_are_found_once(spark):
    """Stitching reads its nodes several times; what finds them runs once."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    nodes = spark.range(24).selectExpr("id AS node", "CAST(id AS INT) AS step", "10.0D AS lat", "100.0D + id AS lon", "20.0D AS wind")
    assert detect.stitch_nodes(nodes.mapInArrow(seen, nodes.schema)).count() == 24
    assert runs.value == 24


def test_tracker_input_of_grids(spark):
    """As for cells; ground is brought onto the axes, and a time without a variable is left out."""
    kinds, keys = ["psl", "uas", "vas", "zg300", "zg500"], ["realization", "time"]
    reading = bindings.storm_fields(spark, f"{DATA}/sf0.001").over(lambda rows: rows.where("realization < 2"))
    fields = reading.grids(kinds)
    cube = detect.places(fields, keys, kinds).unpivot([*keys, "lat", "lon"], kinds, "variable", "value")
    ground = spark.createDataFrame([(float(y), float(x), y + 2.0 * x) for y in (-10, 40) for x in (80, 120)], "lat double, lon double, value double")
    values = ["psl", "ubot", "vbot", "z300", "z500", "phis", "thickness", "wind"]
    for topography in (None, ground):
        want = detect.tracker_input(cube, keys, topography)
        got = detect.places(detect.tracker_input(fields, keys, topography), keys, values)
        assert want.count() == fields.count() * 29 * 25 and want.select(got.columns).exceptAll(got).count() == 0
    read = detect.tracker_input(reading, keys).grids(["thickness", "wind"])
    same = read.join(detect.tracker_input(fields, keys).select(*keys, "thickness", F.col("wind").alias("w")), [*keys, "thickness"])
    apart = F.array_max(F.zip_with("wind", "w", lambda a, b: F.abs(a - b)))  # two libraries' hypot
    assert read.count() == fields.count() == same.where(apart < 1e-12).count()
    some = fields.withColumn("vas", F.when(F.hour("time") > 0, F.col("vas")))
    assert detect.tracker_input(some, keys).where("hour(time) = 0").count() == 0 < detect.tracker_input(some, keys).count()
    left = detect.Reading(some.select(*keys, F.struct("lat", "lon", *kinds).alias("of")), _unpacked)
    assert detect.tracker_input(left, keys).grids(["wind"]).count() == detect.tracker_input(some, keys).count()
    with pytest.raises(detect.InvalidData, match="zg500"):
        detect.tracker_input(fields.drop("zg500"), keys)
    with pytest.raises(Exception, match="no variable zg500"):
        detect.tracker_input(detect.Reading(fields.drop("zg500"), iter), keys).grids(["wind"]).count()


def test_readings_of_other_lengths_are_an_error(spark):
    """Two grids whose lengths differ between variables, but not in sum."""
    kinds = ["psl", "uas", "vas", "zg300", "zg500"]
    fields = bindings.storm_fields(spark, f"{DATA}/sf0.001").over(lambda rows: rows.where("realization = 1 AND k < 2").coalesce(1)).grids(kinds)
    n = F.when(F.col("k") == 0, 724).otherwise(726)
    for v in ("zg300", "vas"):
        bad = fields.withColumn(v, F.slice(F.concat(v, F.array(F.lit(0.0))), F.lit(1), n))
        with pytest.raises(Exception, match="not the same places"):
            detect.detect_nodes(detect.tracker_input(detect.Reading(bad, iter), ["realization", "time"]), ["realization", "time"]).count()


def test_made_fields_are_their_formula(spark):
    fields = bindings.storm_fields(spark, f"{DATA}/sf0.001").grids(["psl", "uas", "vas", "zg300", "zg500"])
    row = fields.where("realization = 3 AND day(time) = 2 AND hour(time) = 0").first()
    k = 4
    for a in (0, 5, 28):
        for b in (0, 11, 24):
            y, x, i = row["lat"][a], row["lon"][b], a * len(row["lon"]) + b
            r2 = (y - 8.1 - k * 0.5 - 3) ** 2 + (x - 100.1 - k * 0.5) ** 2
            wind = 5 + (30 - abs(k - 4.3)) * math.exp(-r2 / 16)
            want = {"psl": 101000 - 3000 * math.exp(-r2 / 4), "uas": 0.6 * wind, "vas": 0.8 * wind, "zg300": 9000 + 30 * math.exp(-r2 / 9), "zg500": 5000.0}
            assert {v: row[v][i] for v in want} == pytest.approx(want, rel=1e-12)
    assert more_queries.QUERIES["src6_7_detect_and_stitch"](spark, f"{DATA}/sf0.001").count() > 0
