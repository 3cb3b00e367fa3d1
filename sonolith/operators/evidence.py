"""Reference-free spectral evidence and the verdict rules on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import db10
from .spectrum import box_smooth

#: Limits of the verdict rules; fixed values.
MIN_FRAMES, MAX_LOSSY_HZ, NEAR_NYQUIST, WALL_DB, GENTLE_DB = 40, 20_750, 0.95, 18.0, 14.0


def knee(ltas: DataFrame, *, shift: int, key: str = "track", half: int = 2) -> DataFrame:
    """(key, knee_bin, drop_db): the steepest change over `shift` bins of the smoothed spectrum.

    ltas: (key, bin, p) with mean powers. The first bin wins ties.
    """
    rows = ltas.withColumn("v", db10(F.col("p"))).withColumn("v", box_smooth("v", [key], "bin", half))
    change = F.lead("v", shift).over(Window.partitionBy(key).orderBy("bin")) - F.col("v")
    rows = rows.withColumn("d", F.floor(change * 1e9 + 0.5) / 1e9).where("d is not null")
    best = rows.groupBy(key).agg(F.min(F.struct("d", "bin")).alias("m"))
    return best.select(key, (F.col("m.bin") + shift // 2).alias("knee_bin"), F.col("m.d").alias("drop_db"))


def spectral_verdict(rows: DataFrame, *, nyquist_hz: float, key: str = "track") -> DataFrame:
    """(key, bucket, reasons, counter) of (key, frames, cutoff_hz, knee_hz, drop_db).

    Reasons alone make a track lossy, counter-evidence alone lossless, both or neither
    leave it undetermined; too few active frames give neither.
    """
    enough = F.col("frames") >= MIN_FRAMES
    low = (F.col("cutoff_hz") < MAX_LOSSY_HZ) & (F.col("cutoff_hz") < NEAR_NYQUIST * nyquist_hz)
    wall, near = F.col("drop_db") > WALL_DB, F.col("knee_hz") >= NEAR_NYQUIST * nyquist_hz
    said = lambda **rules: F.array_compact(F.array(*(F.when(enough & rule, name.replace("_", " ")) for name, rule in rules.items())))
    reasons = said(cutoff=low, brickwall=wall & ~near & (low | (F.col("knee_hz") < MAX_LOSSY_HZ)))
    counter = said(full_band=~low, gentle=low & ~wall & (F.col("drop_db") < GENTLE_DB))
    return rows.select(key, reasons.alias("reasons"), counter.alias("counter")).withColumn("bucket", bucket(F.size("reasons"), F.size("counter")))


def bucket(n_reasons, n_counter):
    return F.when((n_reasons > 0) & (n_counter == 0), "lossy").when((n_reasons == 0) & (n_counter > 0), "lossless").otherwise("undetermined")
