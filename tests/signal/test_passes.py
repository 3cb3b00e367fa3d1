"""Several aggregates from one pass equal those of passes of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.operators import accumulate, passes, psycho, spectrum

RULES = accumulate.Rules(32_000, 256, 256, silent_db=-40.0, cutoff_db=20.0)


@pytest.fixture(scope="module")
def frames(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(400):
        a = r.normal(size=256) * (0.0 if k % 50 == 0 else 1.0 if k % 2 else 0.1)
        rows.append((("x", "y", None)[k % 3], k, a.tolist(), (0.5 * a + 0.01 * r.normal(size=256)).tolist()))
    return spectrum.spectra(spark.createDataFrame(rows, "track string, t long, a array<double>, b array<double>").repartition(5))


def test_one_pass_equals_passes_of_their_own(spark, frames):
    bands = psycho.band_table(psycho.erb_bands(spark, 32_000, 256), 129)
    sinks = {"cross": passes.cross(), "shown": passes.shown(RULES, 4 / (256 * 96.0)), "nmr": passes.noise_to_mask(bands, 0.5)}
    got, seen = passes.run(frames, sinks, {"frames": F.count("*"), "last": F.max("t")})
    assert seen == {"frames": 400, "last": 399}
    known = frames.where("track is not null")
    want = {(r.track, r.bin): r for r in spectrum.cross_spectrum(known).collect()}
    mine = {(r.track, r.bin): r for r in got["cross"].collect()}
    assert {k for k in mine if k[0]} == set(want) and len([k for k in mine if k[0] is None]) == 129
    for k, w in want.items():
        assert mine[k].frames == w.frames and np.allclose([mine[k][c] for c in ("saa", "sbb", "sab_re", "sab_im")], [w[c] for c in ("saa", "sbb", "sab_re", "sab_im")])
    assert sum(r.frames for r in got["cross"].where("bin = 0").collect()) == 400
    shown = got["shown"].where("track is not null")
    per = {r.track: (r.n, r.cuts) for r in shown.groupBy("track").agg(F.max("frames").alias("n"), F.sum("cut").alias("cuts")).collect()}
    assert all(n == cuts for n, cuts in per.values()) and sum(n for n, _ in per.values()) < 267
    for r in accumulate.evidence(shown.withColumn("side", F.lit(None).cast("double")), RULES).collect():
        assert r.frames == per[r.track][0] and r.cutoff_hz > 14_000 and r.side_db is None
    total = psycho.nmr_frames(psycho.noise_to_mask(known, bands, 0.5))
    want_q = {r.track: r.largest for r in psycho.histogram_quantiles(total, "total_db", ["track"], [0.5]).collect()}
    for r in got["nmr"].where("track is not null").groupBy("track").agg(F.sum("c").alias("n"), F.max("m").alias("m")).collect():
        assert r.m == pytest.approx(want_q[r.track]) and r.n in (133, 134)


def test_frames_are_read_once(spark, frames):
    """The counter of a Python step before the pass says how often frames were made."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    got, _ = passes.run(frames.mapInArrow(counted, frames.schema), {"a": passes.cross(), "b": passes.cross(), "c": passes.shown(RULES, 1.0)})
    assert [g.count() > 0 for g in got.values()] == [True] * 3 and made.value == 400


def test_no_frames(spark, frames):
    got, seen = passes.run(frames.where("t < 0"), {"a": passes.cross(), "c": passes.shown(RULES, 1.0)}, {"n": F.count("*")})
    assert [g.count() for g in got.values()] == [0, 0] and seen == {"n": 0}
