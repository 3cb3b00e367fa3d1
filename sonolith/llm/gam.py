"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees: each round visits every feature in turn and fits a tree of
a few leaves over that feature's bins to the current residuals, so a feature's trees add up to
one lookup table. The pairs of features that reduce the remaining loss most then get two-way
tables in the same way. A score is the sum of one table entry a feature and a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, small_batches
from .textstats import FEATURES, features, features_of


@dataclass
class Gam:
    """Bin edges and lookup tables; `pairs` maps (i, j) to a table over coarse bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    bias: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (i, j), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values of a tree over ordered bins with gradients g and weights h: greedy best splits."""
    cuts, gain_of = [0, len(g)], lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:], strict=False):
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            if b - a < 2:
                continue
            left = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge) - gain_of(a, b)
            left[(ch[:-1] < least) | (ch[-1] - ch[:-1] < least)] = -1
            k = int(left.argmax())
            best = max(best, (float(left[k]), a + k + 1))
        if best[1] < 0:
            break
        cuts = sorted({*cuts, best[1]})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 48, coarse_bins: int = 8, rounds: int = 60, pair_rounds: int = 20, n_pairs: int = 6, leaves: int = 3, rate: float = 0.15, ridge: float = 5.0, least: float = 1.0) -> Gam:
    """Fit on rows x (any number, features) with labels y in {0, 1}; one class alone gives a constant."""
    k = x.shape[1]
    if not len(x):
        return Gam([np.zeros(0)] * k, [np.zeros(0)] * k, [np.zeros(1)] * k)
    p = (y.sum() + 1) / (len(y) + 2)
    model = Gam([_edges(x[:, j], bins) for j in range(k)], [_edges(x[:, j], coarse_bins) for j in range(k)], [], bias=float(np.log(p / (1 - p))))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(model.edges[j], x[:, j], "right") for j in range(k)]
    z = np.full(len(x), model.bias)
    for _ in range(rounds):
        for j in range(k):
            prob = 1 / (1 + np.exp(-z))
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(binned[j], y - prob, size), np.bincount(binned[j], prob * (1 - prob), size), leaves, ridge, least)
            model.tables[j] += step
            z += step[binned[j]]
    rough = [np.searchsorted(model.coarse[j], x[:, j], "right") for j in range(k)]
    size = [len(e) + 1 for e in model.coarse]
    prob = 1 / (1 + np.exp(-z))
    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            cell = rough[i] * size[j] + rough[j]
            g, h = (np.bincount(cell, w, size[i] * size[j]) for w in (y - prob, prob * (1 - prob)))
            gains.append((float((g**2 / (h + ridge)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    model.pairs = {(i, j): np.zeros((size[i], size[j])) for i, j in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            prob = 1 / (1 + np.exp(-z))
            cell = rough[i] * size[j] + rough[j]
            g, h = (np.bincount(cell, w, size[i] * size[j]).reshape(size[i], size[j]) for w in (y - prob, prob * (1 - prob)))
            # a depth-two tree: the first feature splits, each side splits the second
            cut = _tree(g.sum(1), h.sum(1), 2, ridge, least)
            step = np.zeros_like(g)
            for side in np.unique(cut):
                rows = cut == side
                step[rows] = rate * _tree(g[rows].sum(0), h[rows].sum(0), 2, ridge, least)
            model.pairs[i, j] += step
            z += step[rough[i], rough[j]]
    return model


def training_rows(rows: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", modulus: int = 5, remainder: int = 0, max_rows: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled documents whose crc32(id) mod `modulus` isn't `remainder`.

    rows: what `features` returns. At most `max_rows` labelled rows are taken, those with the
    smallest hash of the id: the bound on what the driver holds. Null labels are left out; of
    several labels of a document the smallest holds.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col, modulus, remainder)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("double").alias("y"))
    got = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "f", "y").toArrow().sort_by("doc_id")
    return got["f"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, len(FEATURES)), got["y"].to_numpy()


def train(rows: DataFrame, labels: DataFrame, **more) -> Gam:
    """Fit on the labelled ones of `rows`; see `training_rows`."""
    return fit(*training_rows(rows, labels, **more))


def scores(rows: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score) for what `features` returns."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few thousand table entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["f"].flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shared.value.score(x))], ["doc_id", "score"])

    return rows.select("doc_id", "f").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def train_and_score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(doc_id, score) of every whole text, null and empty ones included; one pass over the texts."""
    rows = materialise(features(docs, id_col=id_col, text_col=text_col), "features")
    return scores(rows, train(rows, labels, id_col=id_col, **more))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, in the same columns.

    The labels' rows are found by their features alone, so no text is shuffled; the texts are
    read twice, once to learn and once to judge.
    """
    model = train(features(docs, id_col=id_col, text_col=text_col), labels, id_col=id_col, **more)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            x = np.array([features_of(t or "") for t in batch[text_col].to_pylist()])
            yield batch.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
