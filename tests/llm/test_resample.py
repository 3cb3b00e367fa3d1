"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sonolith.llm import resample

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def brute(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    words = lambda t: [w.decode() for w in WORD.findall((t or "").encode().lower())]
    grams = lambda w: [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
    found = [(i, words(t)) for i, t in rows]
    hashed = [[zlib.crc32(g.encode()) % buckets for g in grams(w)] for _, w in found]
    s, t = Counter(b for h in hashed for b in h), Counter(zlib.crc32(g.encode()) % buckets for x in target for g in grams(words(x)))
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (t_or(s) + buckets)) / ((s[b] + 1) * (t_or(t) + buckets)))) for b in s}
    out = []
    for (i, w), h in zip(found, hashed, strict=True):
        weight = sum(gain[b] for b in h) // len(h) if h else 0
        draw = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((draw + 0.5) / 2**32))), len(w) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def t_or(counts):
    return sum(counts.values())


@pytest.fixture
def rows(invented):
    made = [(k, invented(5 + k % 60, k).upper() if k % 4 else invented(5 + k % 60, k)) for k in range(400)]
    return made + [(1000, None), (1001, ""), (1002, "++ -- "), (1003, "É é Straße ÀÉ " * 30), (None, invented(40, 9)), (1004, "word " * 5000)]


@pytest.mark.parametrize("more", [{}, {"longest": 3, "buckets": 50}, {"percent": 100, "min_words": 1}])
def test_equals_plain_python(spark, docs, rows, more, invented):
    target = spark.createDataFrame([(1, invented(300, 77)), (2, None), (3, "É ok")], "item_id long, text string")
    got = resample.resample(docs(rows).repartition(6), target, **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    names = {"min_words": "least"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, [invented(300, 77), None, "É ok"], **{names.get(k, k): v for k, v in more.items()})


def test_repeated_rows_and_ties(spark, docs, invented):
    same = [(7, invented(30, 1))] * 50
    got = resample.resample(docs(same), docs([(1, "x")]), percent=20).collect()
    assert sorted(r.rank for r in got if r["rank"] is not None) == list(range(1, 11)) and len({r.score for r in got}) == 1


def test_without_documents_or_target(spark, docs, rows):
    assert resample.resample(docs([]), docs([(1, "x")])).count() == 0
    assert sorted(map(tuple, resample.resample(docs(rows), docs([])).collect()), key=str) == brute(rows, [])


def test_large_tables_of_buckets_are_shuffled(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(resample, "BROADCAST_BUCKETS", 0)
    assert sorted(map(tuple, resample.resample(docs(rows), docs(rows[:50])).collect()), key=str) == brute(rows, [t for _, t in rows[:50]])


def test_clashing_names(spark, rows):
    odd = spark.createDataFrame([(*r, "a", 1, 2, 3) for r in rows], "doc_id long, text string, _row string, bucket int, gain int, rank int")
    assert sorted(map(tuple, resample.resample(odd, odd.limit(0)).collect()), key=str) == brute(rows, [])


def test_ranks_over_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 v").repartition(9)
    got = resample.ranked(df, [resample.F.desc("v")]).collect()
    assert all(r["rank"] == 1000 - r.v for r in got) and len(got) == 1000
