"""Stateful streams: frames and block decisions that do not depend on how the input is cut up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _whole_frames(stream: DataFrame, size: int, hop: int, weight: np.ndarray, key: str, pos: str, value: str, per: int) -> DataFrame:
    """(key, t, energy) of frames of `size` samples, `hop` apart, emitted when all of a frame's samples have come.

    The state is keyed by runs of `per` frames, so a long track is many groups of bounded size:
    a sample goes to the one or two runs that hold it. Samples may come in any order, within a
    trigger and between triggers; what has been emitted and is of no more use leaves the state.
    """
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(pos) - size + 1) / hop).cast("long"))
    runs = F.sequence(F.floor(first / per).cast("long"), F.floor(F.col(pos) / hop / per).cast("long"))
    dealt = stream.where(F.col(pos) >= 0).select(F.col(key), F.col(pos).cast("long").alias("pos"), F.col(value).cast("double").alias("x"), F.explode(runs).alias("run"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        origin, length = k[1] * per * hop, (per - 1) * hop + size
        x = np.full(length, np.nan)
        done = np.zeros(per, bool)
        if state.exists:
            at, held, emitted = state.get
            x[np.asarray(at, np.int64)] = held
            done[np.asarray(emitted, np.int64)] = True
        for batch in batches:
            place = batch["pos"].to_numpy() - origin
            x[place] = batch["x"].to_numpy()
        frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
        ready = ~np.isnan(frames).any(1) & ~done
        energy = ((frames[ready] * weight) ** 2).sum(1)
        done |= ready
        wanted = np.zeros(length, bool)
        for j in np.flatnonzero(~done):
            wanted[j * hop : j * hop + size] = True
        keep = np.flatnonzero(wanted & ~np.isnan(x))
        state.update((keep.tolist(), x[keep].tolist(), np.flatnonzero(done).tolist()))
        yield pd.DataFrame({key: pd.Series([k[0]] * int(ready.sum()), dtype=object), "t": k[1] * per + np.flatnonzero(ready), "energy": energy})

    kind = stream.schema[key].dataType.simpleString()
    return dealt.groupBy(key, "run").applyInPandasWithState(step, f"{key} {kind}, t long, energy double", "at array<long>, held array<double>, emitted array<long>", "append", GroupStateTimeout.NoTimeout)


def stft_energy(stream: DataFrame, size: int, hop: int, *, key: str = "track", pos: str = "pos", value: str = "x", per: int = 256) -> DataFrame:
    """(key, t, energy): energy of each whole Hann-windowed frame."""
    return _whole_frames(stream, size, hop, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size), key, pos, value, per)


def envelope(stream: DataFrame, size: int, hop: int, *, key: str = "track", pos: str = "pos", value: str = "x", per: int = 256) -> DataFrame:
    """(key, t, energy): mean square of each whole frame. A `key` that names segments as well starts framing anew in each."""
    return _whole_frames(stream, size, hop, np.full(size, size**-0.5), key, pos, value, per)


def gate(stream: DataFrame, *, key: str, block: str, ok: str, last: str, per: int = 4096) -> DataFrame:
    """(key, block, kept): a block stays if it and its neighbours are aligned; one whose `ok` is null counts as aligned.

    Blocks are numbered from 0 without gaps and may come in any order, within a trigger and between
    triggers. A decision waits for both neighbours; `last` marks the final block of a key, which has
    no successor: a stream has no end of its own, so the source says it, and until then the last
    block is undecided. The state is keyed by runs of `per` blocks, and holds of a run only what
    undecided blocks need.
    """
    number = F.col(block).cast("long")
    runs = F.sequence(F.floor(F.greatest(number - 1, F.lit(0)) / per).cast("long"), F.floor((number + 1) / per).cast("long"))
    dealt = stream.where(number >= 0).select(F.col(key), number.alias("b"), F.coalesce(F.col(ok), F.lit(True)).alias("good"), F.coalesce(F.col(last), F.lit(False)).alias("end"), F.explode(runs).alias("run"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        origin = k[1] * per - 1
        known = np.full(per + 2, -1, np.int8)  # not there yet, not aligned, aligned
        done = np.zeros(per, bool)
        if state.exists:
            at, held, decided = state.get
            known[np.asarray(at, np.int64)] = held
            done[np.asarray(decided, np.int64)] = True
        if k[1] == 0:
            known[0] = 1
        for batch in batches:
            place, good, end = batch["b"].to_numpy() - origin, batch["good"].to_numpy().astype(np.int8), batch["end"].to_numpy().astype(bool)
            inside = (place >= 0) & (place < per + 2)
            known[place[inside]] = good[inside]
            after = place[end] + 1
            known[after[(after >= 0) & (after < per + 2)]] = 1
        near = np.lib.stride_tricks.sliding_window_view(known, 3)
        ready = (near >= 0).all(1) & ~done
        done |= ready
        wanted = np.zeros(per + 2, bool)
        for shift in range(3):
            wanted[shift : shift + per] |= ~done
        keep = np.flatnonzero(wanted & (known >= 0))
        state.update((keep.tolist(), known[keep].tolist(), np.flatnonzero(done).tolist()))
        yield pd.DataFrame({key: pd.Series([k[0]] * int(ready.sum()), dtype=object), block: k[1] * per + np.flatnonzero(ready), "kept": near[ready].min(axis=1) > 0 if ready.any() else np.zeros(0, bool)})

    kind = stream.schema[key].dataType.simpleString()
    return dealt.groupBy(key, "run").applyInPandasWithState(step, f"{key} {kind}, {block} long, kept boolean", "at array<long>, held array<long>, decided array<long>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, into Parquet, and read the result."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
