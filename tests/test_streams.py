"""Streams of several files: updated groups, late rows, and what is run again."""

import os
import time

from pyspark.sql import functions as F

from isobar.streaming import events


def test_late_rows_and_updates(spark, tmp_path):
    """A second file adds to an open window, and its row behind the watermark is dropped."""
    folder = tmp_path / "in"
    minute = lambda m: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, {m})")

    def add(name, rows):
        one = spark.createDataFrame(rows, "m int, event_type string, value double").select(minute("m").alias("ts"), "event_type", "value").coalesce(1)
        one.write.parquet(str(tmp_path / name))
        part = next(p for p in (tmp_path / name).iterdir() if p.suffix == ".parquet")
        folder.mkdir(exist_ok=True)
        os.rename(part, folder / f"{name}.parquet")
        time.sleep(1.1)  # files are taken in the order of their times

    add("a", [(5, "x", 1.0), (50, "x", 3.0), (130, "x", 5.0)])
    add("b", [(200, "x", 7.0)])  # the watermark passes to 190 minutes after this file
    add("c", [(10, "x", 100.0), (195, "x", 9.0), (199, "y", 1.0)])
    run = lambda: events.drain(events.windowed_mean(events.event_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "state"), ["w", "event_type"])
    want = {(0, "x"): (2.0, 2), (2, "x"): (5.0, 1), (3, "x"): (8.0, 2), (3, "y"): (1.0, 1)}
    found = lambda df: {(r["w"]["start"].hour, r["event_type"]): (r["value"], r["n"]) for r in df.collect()}
    assert found(run()) == want
    assert found(run()) == want  # nothing is new
    add("d", [(205, "x", 11.0), (300, "y", 2.0)])
    assert found(run()) == want | {(3, "x"): (9.0, 3), (5, "y"): (2.0, 1)}
    batches = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]
    assert len(batches) >= 4 and spark.read.parquet(str(tmp_path / "out")).count() < 4 * len(batches)
