"""Queries of the streaming extension: events arrive in files, some of them late, and the
stream runs to its end; what it has put out then equals SQL over the whole table."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from loomtext.plans.registry import ORACLES, query
from loomtext.sources.shared import scratch
from loomtext.sources.tables import table
from loomtext.streaming import ordered

#: Files come in so many steps of time; every tenth event comes one step late.
STEPS = 4


def _arriving(spark, sf_dir):
    """(stream, delay): the events, and how long to wait for late ones. The last file has a
    row, of a user that isn't one, whose time is past all waiting: it stays in state itself."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    step = ((last - first) if last else datetime.timedelta(0)) / STEPS + datetime.timedelta(seconds=1)
    folder = scratch(spark, "arriving")
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))) / (step.total_seconds() * 1e6))
    arrives = at + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    for n in range(STEPS + 1):
        events.filter(arrives == n).repartition(2).write.mode("append").parquet(folder)
    end = [(-1, (last or datetime.datetime(2000, 1, 1)) + 4 * step, -1, 0.0)]
    spark.createDataFrame(end, events.schema).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    return stream, f"{int(2 * step.total_seconds()) + 1} seconds"


@query("M_first_seen", "SELECT user_id, epoch_us(ts) AS at, event_id FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR")
def first_seen(spark, sf_dir):
    """Each user's first event, and the first after six silent hours."""
    stream, delay = _arriving(spark, sf_dir)
    out = ordered.first_seen(stream, "user_id", "ts", "event_id", 6 * 3600 * 1000, delay)
    return ordered.run_to_end(out, scratch(spark, "seen"), scratch(spark, "progress"))


@query("M_early_stop", ORACLES["H5_early_stop"])
def early_stop(spark, sf_dir):
    """Where each user's series should have stopped, told while it goes on."""
    stream, delay = _arriving(spark, sf_dir)
    out = ordered.early_stop(stream.withColumnRenamed("user_id", "run"), "run", "ts", "event_id", "value", delay)
    return ordered.run_to_end(out, scratch(spark, "stops"), scratch(spark, "progress"))
