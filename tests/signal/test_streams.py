import numpy as np

from sonolith.streaming import frames


def written(spark, path, rows, schema, files):
    for part in np.array_split(np.arange(len(rows)), files):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def test_frames_do_not_depend_on_the_cuts(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=300)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    want = [((x[s : s + 32] * hann) ** 2).sum() for s in range(0, 269, 8)]
    for files in (1, 7):
        rows = [("t", i, float(v)) for i, v in enumerate(x)]
        rows = rows if files == 1 else [rows[i] for i in np.random.default_rng(2).permutation(len(rows))]  # in any order
        stream = written(spark, str(tmp_path / f"in{files}"), rows, "track string, pos long, x double", files)
        out = frames.drain(frames.stft_energy(stream, 32, 8, per=5), str(tmp_path / f"out{files}"), str(tmp_path / f"log{files}"))
        assert np.allclose([r.energy for r in out.orderBy("t").collect()], want)


def test_gate_does_not_depend_on_cuts_or_order(spark, tmp_path):
    """Any cut and any order of the same rows gives one result; blocks without a known neighbour wait."""
    r = np.random.default_rng(5)
    oks = {"a": [True, True, False, True, None, True, True], "b": [bool(v) for v in r.uniform(size=60) > 0.2], "c": [False], "open": [True, False, True]}
    rows = [(k, i, o, k != "open" and i == len(v) - 1) for k, v in oks.items() for i, o in enumerate(v)]
    flag = lambda v, i: True if not 0 <= i < len(v) or v[i] is None else v[i]
    want = sorted((k, i, flag(v, i - 1) and flag(v, i) and flag(v, i + 1)) for k, v in oks.items() for i in range(len(v) - (k == "open")))
    for n, (files, per) in enumerate(((1, 4096), (6, 7), (3, 1))):
        mixed = rows if files == 1 else [rows[i] for i in r.permutation(len(rows))] + rows[:5]  # some come twice
        stream = written(spark, str(tmp_path / f"in{n}"), mixed, "k string, b long, ok boolean, last boolean", files)
        out = frames.drain(frames.gate(stream, key="k", block="b", ok="ok", last="last", per=per), str(tmp_path / f"out{n}"), str(tmp_path / f"log{n}"))
        assert sorted(map(tuple, out.collect())) == want
