import hashlib
import random
from collections import Counter

from sonolith.llm import suffixdedup


def slow(rows, window):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + window] for _, d in data for k in range(len(d) - window + 1))
    out = []
    for i, d in data:
        cover = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                cover[k : k + window] = b"\1" * window
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((i, len(d), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(d, cover) if not c)).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(docs):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, passage = text(30), [text(60) for _ in range(4)]
    rows = [(k, text(r.randrange(1, 200))) for k in range(30)]
    for k in range(30, 80):
        p = r.choice(passage)
        a = r.randrange(0, len(p) - 20)
        rows.append((k, text(20) + p[a : a + r.randrange(20, 400)] + text(r.randrange(30)) + common))
    rows += [(80, rows[3][1]), (81, rows[3][1] + "x"), (82, "a" * 700), (83, "ab" * 90 + "ab" * 300), (84, None), (85, ""), (86, "a" * 199), (87, "z" * 200), (88, common[:100]), (5, rows[5][1]), (6, "other " + rows[40][1]), (None, rows[7][1]), (None, rows[50][1])]
    got = suffixdedup.dedup(docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows, 200)
    few = rows[:40]
    assert sorted(map(tuple, suffixdedup.dedup(docs(few), window=64).collect()), key=str) == slow(few, 64)


def test_long_texts_in_pieces(docs, monkeypatch):
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(9_000))
    rows = [(1, long), (2, long[3000:3400] + "q" + long[7000:7300]), (3, "x" * 5000)]
    monkeypatch.setattr(suffixdedup, "_PIECE", 1000)
    first, last, *_ = suffixdedup.sampled(long.encode(), suffixdedup.np.array([0]), suffixdedup.np.array([9000]), 200)
    assert first[0] == 0 and last[-1] == 8800 and all(first[1:] == last[:-1] + 1)
    assert sorted(map(tuple, suffixdedup.dedup(docs(rows)).collect()), key=str) == slow(rows, 200)


def test_empty_table(docs):
    assert suffixdedup.dedup(docs([])).count() == 0
