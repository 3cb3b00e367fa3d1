"""Divergence of sources against plain exact arithmetic, over several blocks, slots and rounds."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from sonolith.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs=3, top=200):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t for t in (text or "").encode().translate(divergence.TERM_BYTES).split(b" ") if t]
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in seen[lang].items() if n >= min_docs}
        mine = {s: Counter({t: n for t, n in counts[lang, s].items() if t in kept}) for g, s in groups if g == lang}
        share = lambda c, t, v=len(kept): 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)
        value = lambda p, q: (p - q) ** 2 // q
        whole = sum(mine.values(), Counter())
        for s, c in mine.items():
            pairs = [(-sum(value(share(c, t), share(d, t)) for t in kept), o.encode()) for o, d in mine.items() if o != s]
            terms = [(-value(share(c, t), share(whole, t)), t) for t in c if share(c, t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.fixture
def rows(invented):
    made = [(k, invented(30 + k % 50, k, vocab=60 + 10 * (k % 9)), "en" if k % 3 else "fr", f"s{k % 11}") for k in range(150)]
    made += [(k, "Ä É Wörter wörter ÉÉ x1yéz ONE one oNe", "de", f"quelle {k % 5}") for k in range(200, 212)]
    return made + [(900, None, None, None), (901, "", "en", "empty"), (902, "only here", "solo", "s1"), (903, "one two three", "en", None), (902, "only here", "solo", "s1"), (None, "\n\t 12 ++ ", "zz", "a"), (None, None, "zz", "b")]


@pytest.mark.parametrize("limits", [{}, {"per_slot": 1, "block_terms": 7, "block_entries": 5}, {"per_slot": 2, "block_entries": 40, "top": 3, "min_docs": 1}])
def test_equals_plain_arithmetic(spark, rows, limits):
    got = divergence.audit(spark.createDataFrame(rows, COLUMNS).repartition(5), **limits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows, limits.get("min_docs", 3), limits.get("top", 200))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert {w[2] for w in want if w[0] == "zz"} == {"pair"} and not [w for w in want if w[0] == "solo" and w[2] == "pair"]


def test_tasks_pass_counts_on(spark, rows):
    few = divergence.audit(spark.createDataFrame(rows, COLUMNS).repartition(2), held=20)
    assert sorted(map(tuple, few.collect())) == brute(rows)


def test_shares_are_exact():
    r = np.random.default_rng(5)
    whole = r.integers(1, 1 << 52, 500)
    count = np.minimum(r.integers(0, 1 << 52, 500), whole)
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole, strict=True)]
    p, q = (divergence.shares(x, whole) for x in (count, np.zeros(500, np.int64)))
    assert divergence.gaps(p, q).tolist() == [(int(a) - int(b)) ** 2 // int(b) for a, b in zip(p, q, strict=True)]


def test_empty_table_and_clashing_names(spark, rows):
    assert divergence.audit(spark.createDataFrame([], COLUMNS)).count() == 0
    odd = spark.createDataFrame([(*r, "z", "z", 1, 2) for r in rows], COLUMNS + ", term string, item string, slot int, n int")
    assert sorted(map(tuple, divergence.audit(odd).collect())) == brute(rows)


def test_vectors_travel_whole():
    p = np.array([[1, 10**9 + 1, 7], [2, 3, 1 << 40]])
    sources, back = divergence.unpacked(divergence.packed(["a", 'é"'], p))
    assert sources == ["a", 'é"'] and (back == p).all()
    assert divergence.unpacked(divergence.packed(["a"], np.zeros((1, 0), np.int64)))[1].shape == (1, 0)
