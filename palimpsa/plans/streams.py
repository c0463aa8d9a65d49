"""Streams over the events table, run to their end, with what SQL says of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import placed
from ..operators.recovery import scratch_dir
from ..streaming import eventtime, outbox
from .catalogue import query
from .model import table


def streamed(spark: SparkSession, sf: str, name: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stream over a table's files writes."""
    folder = scratch_dir(spark, f"stream-{name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    source = spark.readStream.schema(table(spark, sf, name).schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        stream = source.parquet(f"{sf}/{name}.parquet")
    else:  # a stream reads folders
        stream = source.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    eventtime.run_to_end(made, stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


#: The watermark follows the latest event by so much; windows that it has passed are given.
DELAY = 3600


@query(
    "streamed_windows",
    f"""WITH w AS (SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
    SELECT 'window' AS kind, key, start, start + INTERVAL 1 HOUR AS stop, n, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {DELAY} SECOND""",
)
def streamed_windows(spark, sf):
    out = streamed(spark, sf, "events", lambda s: eventtime.windows(s, "event_type", "ts", "value", f"{DELAY} seconds", 3600))
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("kind", "key", at("start"), at("stop"), "n", F.round("total", 4).alias("total"))


@query(
    "streamed_sessions",
    f"""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC) AS k FROM e),
    g AS (SELECT user_id::VARCHAR AS key, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 2 HOUR)::TIMESTAMP AS stop, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k)
    SELECT 'window' AS kind, * FROM g WHERE date_trunc('millisecond', stop + INTERVAL 999 MICROSECOND) <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL {DELAY} SECOND""",
)
def streamed_sessions(spark, sf):
    out = streamed(spark, sf, "events", lambda s: eventtime.sessions(s, "user_id", "ts", "value", f"{DELAY} seconds", 7200))
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("kind", "key", at("start"), at("stop"), "n", F.round("total", 4).alias("total"))


@query(
    "sliding_windows",
    """SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
      SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP - to_hours(h) FOR h IN range(3)]) AS s FROM events) GROUP BY 1, 2""",
)
def sliding_windows(spark, sf):
    out = outbox.windowed(table(spark, sf, "events"), "ts", "3 hours", "1 hour")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "gated_stream",
    """WITH o AS (SELECT event_type AS project, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq, event_id FROM events),
    kept AS (SELECT * FROM o WHERE NOT (seq > 500 AND seq % 97 = 0)), p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS place FROM kept)
    SELECT project, seq, event_id::VARCHAR AS payload FROM p WHERE seq = place""",
)
def gated_stream(spark, sf):
    # Numbers are given first, as a stream can not; gaps then hold back what follows them.
    folder = scratch_dir(spark, "stream-numbered")
    rows = placed(table(spark, sf, "events").select("event_type", "event_id"), "event_type", ["event_id"], "seq")
    rows = rows.select("event_type", F.col("seq").cast("long").alias("seq"), F.col("event_id").cast("string").alias("event_id"))
    rows = rows.filter(~((F.col("seq") > 500) & (F.col("seq") % 97 == 0)))
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", 64 << 20).parquet(f"{folder}/in")
    eventtime.run_to_end(lambda s: eventtime.gated(s, "event_type", "seq", "event_id"), stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")
