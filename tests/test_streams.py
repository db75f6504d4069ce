"""Ordered folds over streams: late rows, expiry, equality with a batch version."""

import datetime

import pytest

from loomtext.streaming import monitor, ordered

START = datetime.datetime(2024, 5, 1)
HOUR = datetime.timedelta(hours=1)


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of files in the order given, one a batch: (key, hours, id, value)."""

    def write(*files):
        for rows in files:
            spark.createDataFrame([(k, START + h * HOUR, i, float(v)) for k, h, i, v in rows], "k long, ts timestamp, id long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return spark.readStream.schema("k long, ts timestamp, id long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    return write


def hours(us):
    return (us / 1e6 - START.replace(tzinfo=datetime.timezone.utc).timestamp()) / 3600


def test_first_seen_with_late_rows_and_expiry(spark, arriving, tmp_path):
    stream = arriving(
        [(1, 5, 50, 0), (2, 6, 60, 0), (None, 6, 61, 0)],
        [(1, 3, 30, 0), (3, 7, 70, 0), (1, 10, 100, 0)],  # 3 is late but in time
        [(1, 30, 300, 0), (2, 31, 310, 0), (2, 31, 309, 0)],
        [(3, 32, 320, 0)],
        [(4, 2, 20, 0)],  # too late: the watermark was past it a batch ago
        [(-1, 1000, 0, 0)],
    )
    out = ordered.first_seen(stream, "k", "ts", "id", 12 * 3600 * 1000, "10 hours")
    got = ordered.run_to_end(out, f"{tmp_path}/out", f"{tmp_path}/c").collect()
    assert sorted((r["k"], hours(r["at"]), r["id"]) for r in got) == [(1, 3, 30), (1, 30, 300), (2, 6, 60), (2, 31, 309), (3, 7, 70), (3, 32, 320)]


def test_a_stream_goes_on_where_it_stopped(spark, arriving, tmp_path):
    """Early stop over two runs of one stream, with a late step between."""
    losses = [9, 8, 7, 7.1, 7.1, 6.9, 7, 7, 7, 7, 7, 3, 2]
    rows = [(1, h, h, float(v)) for h, v in enumerate(losses)]
    stop = lambda: ordered.run_to_end(ordered.early_stop(arriving(), "k", "ts", "id", "v", "3 hours"), f"{tmp_path}/out", f"{tmp_path}/c").collect()
    arriving([r for r in rows[:8] if r[1] != 6])
    assert stop() == []
    arriving([rows[6], *rows[8:]], [(-1, 1000, 0, 0.0)])
    assert [(r["k"], r["stop_step"]) for r in stop()] == [(1, 11)]  # the fifth in a row without a better one


def test_batch_form(spark):
    table = spark.createDataFrame([(1, START), (1, START), (2, START)], "k long, ts timestamp")
    assert monitor.first_seen(table, "k").count() == 2
