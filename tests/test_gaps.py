"""Tracks and sessions end at gaps of more than a day, to the microsecond."""

import pytest
from pyspark.sql import functions as F

from isobar.operators import tracks
from isobar.plans.more_queries import ORACLE_SQL, QUERIES

from .conftest import DATA, TABLES, as_rows, oracle

DAY = 86_400_000_000
NAMES = """agg29_34_storm_stats agg33_pressure_energy agg39_41_density agg39_full_grid agg42_spatial_bundle agg43_genesis_over agg43_histogram2d src4_snk2_track_text
    stream_sessions fil12_storm_time fil13_14_basin fil15_track_wind fun5_arc_points fun5_great_circle src7_stitch""".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twenty users with four events each, whose gaps are a day and 0, 1, 500,000 or
    1,000,000 microseconds in turn."""
    where = tmp_path_factory.mktemp("gaps")
    over, rows = (0, 1, 500_000, 1_000_000), []
    for u in range(20):
        at = 1_704_067_200_000_000 + u * 1_234_567
        for k in range(4):
            rows.append((len(rows), at, u, "view", 10.0 + (u * 53 + k * 97) % 290, "{}"))
            at += DAY + over[(u + k) % 4]
    made = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string")
    made = made.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us").coalesce(1)
    made.write.parquet(str(where / "made"))
    next((where / "made").glob("*.parquet")).rename(where / "events.parquet")
    for t in TABLES:
        if t != "events":
            (where / f"{t}.parquet").symlink_to(f"{DATA}/sf0.001/{t}.parquet")
    return str(where)


@pytest.mark.parametrize("name", NAMES)
def test_fractions_of_a_gap_count(spark, folder, name):
    assert as_rows(QUERIES[name](spark, folder).toPandas()) == as_rows(oracle(ORACLE_SQL[name], folder))


def test_stitch_ends_at_a_microsecond(spark, folder):
    got = tracks.stitch(spark.read.parquet(f"{folder}/events.parquet"), 86400).where("user_id = 0").orderBy("event_id").collect()
    assert [r["track"] for r in got] == [0, 0, 1, 2]
