"""Quality rules: learned decision lists.

Sequential covering on labelled statistics: a rule is a conjunction of thresholds, grown
literal by literal for the best information gain on two thirds of the rows, pruned back on the
other third, and kept while it is precise there; the rows it covers leave and the next rule is
learned. The list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise
from .textstats import FEATURES, RULE_STATS, all_stats

#: Columns that rules may test: derived from the counts, as SQL, and the features of a text as they are.
TESTS = {
    "words": "double(n_words)",
    "mean_word": "word_chars / double(greatest(n_words, 1))",
    "symbols_per_word": "n_symbols / double(greatest(n_words, 1))",
    "dup_lines_per_100_words": "100 * n_dup_lines / double(greatest(n_words, 1))",
    "repeat_share": "n_repeat_words / double(greatest(n_words, 1))",
    **{name: name for name in FEATURES},
}


@dataclass(frozen=True)
class Rule:
    """All of (column, is_lower_bound, threshold) hold: the document is rejected."""

    literals: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, lower, value in self.literals:
            c = F.col(name)
            out = out & ((c >= value) if lower else (c < value))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if lo else '<'} {v:g}" for n, lo, v in self.literals)


def _holds(x: dict[str, np.ndarray], literals) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, lower, value in literals:
        out &= (x[name] >= value) if lower else (x[name] < value)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, thresholds: dict[str, np.ndarray], most: int) -> list:
    literals, inside = [], np.ones(len(bad), bool)
    for _ in range(most):
        p, n = bad[inside].sum(), inside.sum()
        if not p or p == n:
            break
        base, best = np.log2(p / n), (1e-9, None)
        for name, values in thresholds.items():
            v, b = x[name][inside], bad[inside]
            at = np.searchsorted(values, v, "right")
            pos, all_ = (np.cumsum(np.bincount(at, w, len(values) + 1)) for w in (b, np.ones(len(b))))
            for lower in (True, False):
                pp, nn = (pos[-1] - pos[:-1], all_[-1] - all_[:-1]) if lower else (pos[:-1], all_[:-1])
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1e-9) / np.maximum(nn, 1)) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, lower, float(values[k])))
        if best[1] is None:
            break
        literals.append(best[1])
        inside &= _holds(x, [best[1]])
    return literals


def _worth(x, bad, literals) -> float:
    inside = _holds(x, literals)
    p, n = bad[inside].sum(), (~bad[inside]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_literals: int = 4, min_precision: float = 0.9, min_covered: int = 5, cuts: int = 64) -> list[Rule]:
    """Rules that reject rows marked `bad`, in order. Fewer than `min_covered` bad rows give none."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < max_rules and bad[left].sum() >= min_covered:
        prune = np.arange(len(left)) % 3 == 2
        part = lambda at: ({k: v[at] for k, v in x.items()}, bad[at])
        grow_x, grow_bad = part(left[~prune])
        prune_x, prune_bad = part(left[prune])
        thresholds = {k: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[1:-1])) for k, v in grow_x.items()}
        literals = _grow(grow_x, grow_bad, thresholds, max_literals)
        while len(literals) > 1 and _worth(prune_x, prune_bad, literals[:-1]) >= _worth(prune_x, prune_bad, literals):
            literals = literals[:-1]
        if not literals:
            break
        hit = _holds({k: v[left] for k, v in x.items()}, literals)
        unseen = hit & prune
        precision = (bad[left][unseen].sum() + 1) / (unseen.sum() + 2)
        overall = bad[left][hit].mean() if hit.any() else 0.0
        if hit.sum() < min_covered or overall < min_precision or precision < min_precision - 0.1:
            break
        rules.append(Rule(tuple(literals), float(overall), int(hit.sum())))
        left = left[~hit]
    return rules


def with_tests(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.expr(v) for k, v in TESTS.items() if k not in stats.columns})


def training_rows(stats: DataFrame, labels: DataFrame, *, label_col: str = "quality", modulus: int = 5, remainder: int = 0, max_rows: int = 100_000) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Test values and bad marks of at most `max_rows` labelled rows, by the hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.min(label_col).alias("y"))
    rows = with_tests(stats).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", *TESTS, "y").toArrow()
    return {k: rows[k].to_numpy().astype(float) for k in TESTS}, rows["y"].to_numpy() == 0


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over the columns of `with_tests`: True keeps."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Statistics, base verdict and verdict of every whole text.

    The list is learned from labelled documents that the base rules pass. Null and empty
    texts have zero counts and fail the base rules. Repeated rows are judged each.
    """
    stats = materialise(all_stats(docs, id_col=id_col, text_col=text_col), "rule-stats")
    stats = stats.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    x, bad = training_rows(stats.where("not base_failed"), labels.withColumnRenamed(id_col, "doc_id"), **more)
    rules = learn(x, bad)
    judged = with_tests(stats)
    return judged.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules))).select("doc_id", *RULE_STATS, "base_failed", "kept")
