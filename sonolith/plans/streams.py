"""Queries that run a file stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numeric as n
from ..operators.shared import shared_dir
from ..streaming import frames
from .alignment import SQL as _BATCH
from .roles import r6


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")


def _drained(spark, stream):
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return frames.drain(stream, f"{at}/out", f"{at}/log")


def stft_stream(spark, d):
    s = _events(spark, d).select(F.lit(0).alias("track"), F.col("event_id").alias("pos"), F.col("value").alias("x"))
    return _drained(spark, frames.stft_energy(s, 64, 32)).select("t", n.r6(F.col("energy")).alias("energy"))


def envelope_stream(spark, d):
    """Each channel's part of the signal as a segment of its own: framing starts anew, nothing crosses from one to the next."""
    e = _events(spark, d).select(F.floor(F.col("event_id") / 1000).cast("long").alias("segment"), (F.col("event_id") % 1000).alias("pos"), F.col("value").alias("x"))
    return _drained(spark, frames.envelope(e, 20, 10, key="segment")).select("segment", "t", n.r6(F.col("energy")).alias("energy"))


def gate_stream(spark, d):
    """Each thousand events as a track of blocks, kept where they and their neighbours are not among the largest values.

    The last block of a track that is not full yet waits for its successor.
    """
    at = F.col("event_id") % 1000
    s = _events(spark, d).select(F.floor(F.col("event_id") / 1000).cast("long").alias("segment"), at.alias("block"), (F.col("value") < 60).alias("ok"), (at == 999).alias("last"))
    return _drained(spark, frames.gate(s, key="segment", block="block", ok="ok", last="last", per=256))


QUERIES = {f.__name__: f for f in (stft_stream, envelope_stream, gate_stream)}
SQL = {
    "stft_stream": _BATCH["hann_frames_energy"],
    "envelope_stream": f"""WITH s AS (SELECT event_id // 1000 AS segment, event_id % 1000 AS pos, value FROM events)
        SELECT segment, t, {r6("avg(value * value)")} AS energy FROM s, (SELECT unnest(range(100)) AS t) WHERE pos BETWEEN t * 10 AND t * 10 + 19 GROUP BY 1, 2 HAVING count(*) = 20""",
    "gate_stream": """SELECT segment, block, kept FROM (SELECT event_id // 1000 AS segment, event_id % 1000 AS block, min((value < 60)::INT) OVER w = 1 AS kept, lead(event_id) OVER w IS NULL AND event_id % 1000 < 999 AS waits
        FROM events WINDOW w AS (PARTITION BY event_id // 1000 ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) WHERE NOT waits""",
}
