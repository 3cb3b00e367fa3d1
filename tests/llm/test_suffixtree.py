import math
import re
import zlib
from collections import Counter

import pytest

from sonolith.llm import suffixtree


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def corpus(invented):
    import random

    r = random.Random(4)
    chain = {w: r.sample(range(30), 3) for w in range(30)}
    rows = []
    for k in range(120):
        w, out = r.randrange(30), []
        for _ in range(60):
            out.append(f"w{w}")
            w = r.choice(chain[w]) if r.random() < 0.9 else r.randrange(30)
        rows.append((k, " ".join(out)))
    return rows + [(200 + k, invented(50, k)) for k in range(40)] + [(300, None), (301, ""), (302, "É W1\x0bw1"), (1, rows[1][1])]


def slow_score(rows, min_count, min_follow, max_depth, least_gain):
    """The same tree from plain dictionaries."""
    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    follow = {}
    for ws in train:
        for k in range(len(ws)):
            for d in range(1, max_depth + 1):
                if k >= d:
                    follow.setdefault(tuple(ws[k - d : k]), Counter())[ws[k]] += 1
    base = lambda w: (c[w] + 1) / (n + v + 1)
    heads = {w for w in c if w is not None and c[w] >= min_count}
    candidates = {1: {(w,) for w in heads}}
    for d in range(2, max_depth + 1):
        candidates[d] = {(*s, w) for s in candidates[d - 1] for w, k in follow[s].items() if k >= max(min_count, min_follow) and w in heads and (*s, w)[1:] in candidates[d - 1]}
    kept = {}

    def p(w, s):
        """Smoothed by the longest retained suffix of s, s itself included."""
        while s and s not in kept:
            s = s[1:]
        if not s:
            return base(w)
        f, cs, es = kept[s]
        return (f.get(w, 0) + es * p(w, s[1:])) / (cs + es)

    rejected = 0
    for d in candidates:
        fresh = {}
        for s in candidates[d]:
            total = sum(follow[s].values())
            f = {w: k for w, k in follow[s].items() if k >= min_follow}
            if not f:
                continue
            cs = sum(f.values())
            es = total - cs + len(f)
            gain = sum(k * math.log((k - 1 + es * p(w, s[1:])) / (cs - 1 + es) / p(w, s[1:])) for w, k in f.items()) + (total - cs) * math.log(es / (cs + es))
            if gain / total >= least_gain:
                fresh[s] = (f, cs, es)
            else:
                rejected += 1
        kept |= fresh
    out = {}
    for i, t in rows:
        ws = words(t)
        score = sum(math.log10(p(w, tuple(ws[max(0, k - max_depth) : k]))) for k, w in enumerate(ws))
        out[i] = (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(base(w)) for w in ws), score)
    return out, kept, rejected


ARGS = dict(min_count=15, min_follow=2, max_depth=3, least_gain=0.02)


@pytest.mark.parametrize("more", [{}, {"block_bytes": 2000}, {"block_bytes": 2000, "max_pairs": 0}])
def test_equals_plain_dictionaries(docs, invented, more):
    rows = corpus(invented)
    want, kept, rejected = slow_score(rows, **ARGS)
    assert {1, 2} <= {len(s) for s in kept} and rejected > 10
    got = suffixtree.train_and_score(docs(rows), **more, **ARGS).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4])
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_distributions_sum_to_one(docs, invented):
    blocks = suffixtree.encode(docs(corpus(invented))).cache()
    tree, found, pairs = suffixtree.learn(blocks, **ARGS)
    c = {r.t: r.c for r in found.collect()}
    assert sum(map(tree.base, c.values())) + tree.base(0) == pytest.approx(1)  # and one unknown word
    n = {}
    for r in pairs.collect():
        n.setdefault(r.s, {})[r.t] = r.n
    assert n and all(tree.kept[s] for s in n)
    for s in [s for s in n if s <= len(tree.heads)][:5]:
        p = [(n[s].get(t, 0) + tree.escape[s] * tree.base(k)) / (tree.seen[s] + tree.escape[s]) for t, k in c.items()]
        assert sum(p) + tree.escape[s] * tree.base(0) / (tree.seen[s] + tree.escape[s]) == pytest.approx(1)


def test_bound_on_contexts(docs, invented):
    blocks = suffixtree.encode(docs(corpus(invented))).cache()
    tree, _, _ = suffixtree.learn(blocks, min_count=2, min_follow=2, max_contexts=40)
    assert 1 < len(tree.kept) <= 41


def test_empty_tables(docs):
    assert suffixtree.train_and_score(docs([])).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = suffixtree.train_and_score(docs([(held, "a b"), (held, None)])).collect()
    assert sorted(x.n_tokens for x in r) == [1, 3] and {(x.train_tokens, x.base_score, x.score) for x in r} == {(0, 0.0, 0.0)}


def test_text_ids(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", None), (None, "three")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_tokens) for r in suffixtree.train_and_score(rows).collect()) == [("", 2), ("a", 3), ("b", 1)]


def test_no_context_is_dropped_without_a_limit(docs):
    """More words than any fixed limit had room for; each is a context."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:70]
    blocks = suffixtree.encode(docs([(i, " ".join(f"w{1000 * k + j}" for j in range(1000))) for k, i in enumerate(ids)]))
    tree, _, _ = suffixtree.learn(blocks, min_count=1, min_follow=2, max_depth=1)
    assert len(tree.heads) == 70_000
