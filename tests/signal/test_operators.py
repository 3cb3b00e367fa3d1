import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import numeric as n
from sonolith.functions import privacy
from sonolith.operators import align, library, psycho, robust, spectrum, trials


def frames_of(spark, a, b, size=256):
    k = len(a) // size
    rows = [("t", i, a[i * size : (i + 1) * size].tolist(), b[i * size : (i + 1) * size].tolist()) for i in range(k)]
    return spectrum.spectra(spark.createDataFrame(rows, "track string, t long, a array<double>, b array<double>"))


@pytest.mark.parametrize("snr", [40, 20, 6])
def test_injected_snr_is_recovered(spark, snr):
    r = np.random.default_rng(1)
    a = r.normal(size=256 * 300)
    b = -0.5 * a + r.normal(size=len(a)) * 0.5 * 10 ** (-snr / 20)
    cross = spectrum.cross_spectrum(frames_of(spark, a, b))
    gains = spectrum.gain(cross)
    assert gains.first().gain == pytest.approx(-0.5, abs=0.01)
    s = spectrum.band_stats(cross, spark.createDataFrame([(0, 1, 128)], "band long, lo long, hi long"), gains).first()
    assert 10 * np.log10(s.coherent / s.incoherent) == pytest.approx(snr, abs=0.2)


def test_merge_equals_single_pass(spark):
    r = np.random.default_rng(2)
    f = frames_of(spark, r.normal(size=256 * 40), r.normal(size=256 * 40)).cache()
    parts = spectrum.cross_spectrum(f.where("t < 15")).union(spectrum.cross_spectrum(f.where("t >= 15")))
    one, two = (x.orderBy("bin").toPandas().drop(columns="track") for x in (spectrum.cross_spectrum(f.repartition(7)), spectrum.merge(parts)))
    assert np.allclose(one, two)


def test_frames_do_not_depend_on_partitions(spark):
    x = spark.range(1000).select(F.lit("t").alias("track"), F.col("id").alias("pos"), (F.col("id") * 1.0).alias("x"))
    for parts in (1, 7):
        got = spectrum.frame_signal(x.repartition(parts), 64, 16).orderBy("t").collect()
        assert [g.frame for g in got] == [list(map(float, range(s, s + 64))) for s in range(0, 937, 16)]


@pytest.mark.parametrize("lag", [0, 1, -1, 7, -7, 37])
def test_lag_is_found(spark, lag):
    r = np.random.default_rng(3)
    x = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.normal(size=800))], "pos long, x double")
    rows = align.lag_correlations(x, x.select((F.col("pos") + lag).alias("pos"), (-2 * F.col("x")).alias("x")), 50)
    best = align.first_best(rows, F.abs("rho"), F.col("lag"), []).first()
    assert best.lag == lag and best.rho == pytest.approx(-1)


@pytest.mark.parametrize("delay", [0.1, 0.25, -0.3, 0.5, -0.45])
def test_fraction_of_a_sample(delay):
    t = np.arange(512)
    x = np.sin(2 * np.pi * t * 5 / 512) + np.cos(2 * np.pi * t * 40 / 512)
    assert align.refined(x[None], align.fractional_shift(x, delay)[None])[0][0] == pytest.approx(delay, abs=1e-3)
    with pytest.raises(ValueError):
        align.fractional_shift(x[:7], delay)


def test_warp_follows_a_sine(spark):
    x = spark.range(600).select(F.col("id").alias("pos"), F.sin(F.col("id") * 0.3).alias("x"))
    got = align.warp(x, 0.001, 0.4).collect()
    assert len(got) > 500
    assert max(abs(r.y - np.sin(0.3 * (r.pos - (0.4 + 0.001 * r.pos)))) for r in got) < 1e-3


def test_robust_line_ignores_outliers(spark):
    pts = [("k", float(i), 2 - 0.01 * i + (50 if i % 4 == 1 else 0)) for i in range(24)]
    p = spark.createDataFrame(pts, "key string, x double, y double")
    fit = robust.theil_sen(p, "key", "x", "y")
    assert fit.first().slope == pytest.approx(-0.01) and robust.mad(p, fit, "key", "x", "y").first().mad < 1e-9


def test_block_gate(spark):
    oks = [True, None, True, False, True, True, True, False]
    b = spark.createDataFrame([("k", i, o) for i, o in enumerate(oks)], "key string, i long, ok boolean")
    kept = [r.kept for r in align.eroded_blocks(b, "ok", key="key", order="i").orderBy("i").collect()]
    assert kept == [True, True, False, False, False, True, False, False]


def test_statistics(spark):
    tails = {(r.n, r.k): r.tail for r in trials.binomial_tails(spark, 16).collect()}
    assert tails[16, 12] == pytest.approx(0.0384064, abs=1e-6) and tails[16, 11] > 0.05 and tails[10, 0] == pytest.approx(1)
    row = spark.range(1).select(*n.wilson(F.lit(8.0), F.lit(10.0)), *n.wilson(F.lit(0.0), F.lit(0.0)), n.sidak(0.05, F.lit(2)), n.sidak(0.05, F.lit(1))).first()
    assert row[0] == pytest.approx(0.4902, abs=1e-4) and row[1] == pytest.approx(0.9433, abs=1e-4) and tuple(row[2:4]) == (0.0, 1.0)
    assert row[4] == pytest.approx(0.025321, abs=1e-6) and row[5] == 0.05
    runs = spark.createDataFrame([("all", i, True) for i in range(20)] + [("none", i, False) for i in range(20)] + [("mix", i, i % 2 == 0) for i in range(9)], "key string, i long, ok boolean")
    got = {r.key: (r.decision, r["at"]) for r in trials.sequential(runs, key="key", order="i", correct="ok").collect()}
    assert got == {"all": ("shown", 8), "none": ("not_shown", 4), "mix": ("open", 9)}


def test_masking_is_monotone_in_noise(spark):
    r = np.random.default_rng(5)
    a = r.normal(size=256 * 8)
    bands = psycho.band_table(psycho.erb_bands(spark, 32_000, 256), 129)
    found = []
    for level in (0.0, 0.01, 0.1):
        z = frames_of(spark, a, a + level * r.normal(size=len(a)))
        found.append(psycho.nmr_frames(psycho.noise_to_mask(z, bands, 1.0)).agg(F.avg("total_db")).first()[0])
    assert found[0] < -100 < found[1] < found[2]


def test_ladder(spark):
    rungs = spark.createDataFrame([("a", 64, 10.0), ("a", 128, 20.0), ("a", 256, 30.0), ("b", 64, 1.0), ("c", 64, 5.0), ("c", 128, None), ("d", 64, 9.0), ("d", 96, 8.0), ("d", 128, 12.0)], "key string, kbps long, value double")
    tests = spark.createDataFrame([("a", 1, 15.0), ("a", 2, 40.0), ("a", 3, 5.0), ("a", 4, None), ("b", 5, 1.0), ("c", 6, 5.0), ("d", 7, 10.5), ("e", 8, 1.0)], "key string, i long, test double")
    got = {r.i: (r.position, r.kbps and round(r.kbps, 3), r.lower_kbps, r.upper_kbps, r.monotonic) for r in library.place(rungs, tests, "key").collect()}
    assert got[1] == ("within", round(2**6.5, 3), 64, 128, True) and got[2] == ("above", None, 256, None, True) and got[3] == ("below", None, None, 64, True)
    assert all(got[i][0] == "unknown" for i in (4, 5, 6, 8)) and got[7][0] == "within" and got[7][4] is False


def test_privacy(spark):
    t = spark.createDataFrame([(r'open "D:\My Music\Ann\x y.flac" now',), ("https://ann.example/x",), (r"C:\Users\ann",), ("annual report",), ("",)], "t string")
    clean = [r[0] for r in t.select(privacy.scrub(F.col("t"), [], ["ann"])).collect()]
    assert clean == ['open "My Music\\<REDACTED>\\x y.flac" now', "https://<REDACTED>.example/x", "Users<REDACTED>", "annual report", ""]
    left = t.select(privacy.audit(privacy.scrub(F.col("t"), [], ["ann"]), [], ["ann"])).collect()
    assert all(r[0] == [] for r in left)


def test_paths(spark):
    """Paths of either kind at both ends of a text, beside each other, with blanks, without a component, and what is none."""
    cases = [
        (r"D:\Secret Folder\x.flac", "x.flac"), (r"D:\a b", "a b"), (r"in E:/only/dir/ it", "in dir it"), ("E:/", "<PATH>"), (r"\\host\share", "<PATH>"), (r"\\host\share\t\u now", "u now"),
        (r"'C:\a.wav''F:\b\c.wav'", "'a.wav''c.wav'"), ("https://x.y/z", "https://x.y/z"), ("a: b", "a: b"), (r"C:\Users\ann<b>", "ann<b>"), ("1C:/x/y", "1y"), (None, None), ("", ""),
        ("C:/" + "a " * 140 + ".flac", "a " + "a " * 138 + "a .flac"), ("C:/" + "a" * 300 + ".flac", "a" * 300 + ".flac"),
    ]
    t = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k long, t string").coalesce(1)
    got = {r.k: r[1] for r in t.select("k", privacy.hide_paths(F.col("t"))).collect()}
    assert {k: (cases[k][0], x) for k, x in got.items() if x != cases[k][1]} == {}


def test_secrets_and_commands(spark):
    assert privacy.distinct_secrets([" abc ", "ab", "", "abc", "longer", "xyz"]) == ["longer", "abc", "xyz"]
    t = spark.createDataFrame([(["enc", "-i", r"D:\My Music\a b.flac", "C:/t/out.opus", "-b:a", "96k", "tmp123"],), ([],)], "args array<string>")
    got = [r[0] for r in t.select(privacy.scrub_command(F.col("args"), {"C:/t/out.opus": "<OUT>", "tmp123": "<TMP DIR>"})).collect()]
    assert got == ['enc -i "a b.flac" <OUT> -b:a 96k "<TMP DIR>"', ""]
    left = t.limit(1).select(privacy.audit(F.lit(r"x/ann y\Ann\z C:\q KEY1"), ["KEY1", "KEY2"], ["ann"])).first()[0]
    assert left == ["KEY1", "/ann", r"\Ann", r"C:\q"]


def test_scan_cache(spark):
    f = spark.createDataFrame([("a", 1, 10, "r1"), ("b", 2, 20, "r1"), ("c", 3, 30, "r1")], "path string, size long, mtime_ns long, rules string")
    c = spark.createDataFrame([("a", 1, 10, "r1"), ("b", 2, 21, "r1"), ("c", 3, 30, "r0"), ("a", 1, 10, "r1")], "path string, size long, mtime_ns long, rules string")
    hits, misses = library.split_by_cache(f, c)
    assert [r.path for r in hits.collect()] == ["a"] and sorted(r.path for r in misses.collect()) == ["b", "c"]
    assert library.split_by_cache(f, c, rescan=True)[1].count() == 3
