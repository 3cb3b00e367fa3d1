"""Several aggregates from one pass over frames.

Each sink turns a batch of spectra into sums, or maxima, for cells: bins, bands or steps of a
histogram. All sinks' partial states leave a task together, tagged; they are added and written as one
small table, and each sink reads its own part. The frames are never written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import accumulate, psycho
from .shared import written
from .spectrum import _matrix

Made = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Sink:
    """`make` of (are, aim, bre, bim) gives (frame, cell, sums, maxima): whose frame, which cell, and a row of values for each.

    sums and maxima name the columns of the result, `cell` that of the cells; `whole` ones are long.
    """

    make: Made
    cell: str
    sums: tuple[str, ...]
    maxima: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()


def _every_bin(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, bins = values[0].shape
    return np.repeat(np.arange(n), bins), np.tile(np.arange(bins), n), np.stack([v.ravel() for v in values], axis=1), np.zeros((n * bins, 0))


def cross() -> Sink:
    """(bin, saa, sbb, sab_re, sab_im, frames), as `spectrum.cross_spectrum`."""
    return Sink(lambda ar, ai, br, bi: _every_bin([ar * ar + ai * ai, br * br + bi * bi, ar * br + ai * bi, ar * bi - ai * br, np.ones_like(ar)]), "bin", ("saa", "sbb", "sab_re", "sab_im", "frames"), whole=("frames",))


def noise_to_mask(bands: psycho.BandTable, gain: float, lo: float = -100.0, step: float = 0.5, n_bins: int = 320) -> Sink:
    """(b, c, pos, m): the histogram of the frames' mean noise-to-mask ratio in dB, those above 0, and the largest."""

    def make(ar: np.ndarray, ai: np.ndarray, br: np.ndarray, bi: np.ndarray):
        noise = ((br - gain * ar) ** 2 + (bi - gain * ai) ** 2) @ bands.member
        total = 10 * np.log10((np.maximum(noise, 1e-30) / psycho._thresholds(psycho._power(ar, ai), bands)).mean(axis=1))
        place = np.clip(np.floor((total - lo) / step), 0, n_bins - 1).astype(np.int64)
        return np.arange(len(total)), place, np.stack([np.ones(len(total)), total > 0], axis=1), total[:, None]

    return Sink(make, "b", ("c", "pos"), ("m",), whole=("c", "pos"))


def shown(rules: accumulate.Rules, scale: float) -> Sink:
    """(bin, frames, mid, cut) of the reference as `accumulate.evidence` takes it, with powers times `scale`; frames of one channel."""

    def make(ar: np.ndarray, ai: np.ndarray, br: np.ndarray, bi: np.ndarray):
        active, power, last = accumulate.of_power((ar * ar + ai * ai) * scale, rules)
        if not active.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros((0, 0))
        cut = (last[:, None] == np.arange(power.shape[1])).astype(float)
        frame, cell, sums, most = _every_bin([np.ones_like(power), power, cut])
        return np.flatnonzero(active)[frame], cell, sums, most

    return Sink(make, "bin", ("frames", "mid", "cut"), whole=("frames", "cut"))


def run(frames: DataFrame, sinks: dict[str, Sink], observed: dict[str, Column] | None = None, key: str = "track") -> tuple[dict[str, DataFrame], dict]:
    """(results by name, observed values): all `sinks`, and aggregates of the frames' own columns, from one pass.

    frames: those of `spectrum.spectra`. A result has a row for each key and cell that some frame
    gave; without frames it has none. Null keys are a key. What leaves a task is one row a key, sink
    and cell of an Arrow batch.
    """
    wide = max(len(s.sums) for s in sinks.values()), max(len(s.maxima) for s in sinks.values())
    names = [key, "sink", "cell", *(f"s{k}" for k in range(wide[0])), *(f"m{k}" for k in range(wide[1]))]
    kind = frames.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spectra = [_matrix(batch[c], batch.num_rows) for c in ("are", "aim", "bre", "bim")]
            coded = batch[key].dictionary_encode()
            owner = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            for name, sink in sinks.items():
                frame, cell, sums, most = sink.make(*spectra)
                if not len(frame):
                    continue
                groups, place = np.unique(np.stack([owner[frame], cell]), axis=1, return_inverse=True)
                place, n = place.ravel(), groups.shape[1]
                columns = [np.bincount(place, weights=sums[:, k], minlength=n) if k < sums.shape[1] else None for k in range(wide[0])]
                for k in range(wide[1]):
                    top = np.full(n, -np.inf)
                    if k < most.shape[1]:
                        np.maximum.at(top, place, most[:, k])
                    columns.append(top if k < most.shape[1] else None)
                keys = coded.dictionary.take(pa.array([None if g == len(coded.dictionary) else g for g in groups[0].tolist()], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys.cast(batch.schema.field(key).type), pa.array([name] * n), pa.array(groups[1]), *(pa.nulls(n, pa.float64()) if c is None else pa.array(c.astype(float)) for c in columns)], names=names)

    rows = frames.select(key, "are", "aim", "bre", "bim")
    watch = Observation() if observed else None
    if watch is not None:
        rows = frames.observe(watch, *(c.alias(n) for n, c in observed.items())).select(key, "are", "aim", "bre", "bim")
    made = rows.mapInArrow(partial, f"`{key}` {kind}, sink string, cell long, " + ", ".join(f"{c} double" for c in names[3:]))
    table = written(made.groupBy(key, "sink", "cell").agg(*(F.sum(c).alias(c) for c in names[3 : 3 + wide[0]]), *(F.max(c).alias(c) for c in names[3 + wide[0] :])), "sinks")
    out = {}
    for name, sink in sinks.items():
        values = [(c, f"{part}{k}") for part, columns in (("s", sink.sums), ("m", sink.maxima)) for k, c in enumerate(columns)]
        out[name] = table.where(F.col("sink") == name).select(key, F.col("cell").alias(sink.cell), *((F.col(v).cast("long") if c in sink.whole else F.col(v)).alias(c) for c, v in values))
    if watch is None:
        return out, {}
    # Spark drops the observation of a plan that it finds to be empty
    return out, frames.agg(*(c.alias(n) for n, c in observed.items())).first().asDict() if table.isEmpty() else watch.get
