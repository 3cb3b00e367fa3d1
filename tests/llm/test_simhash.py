import random

import xxhash

from sonolith.llm import simhash


def slow(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, min(len(words), 1)))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps):
    """Smallest id reachable, by brute force over all pairs."""
    own = {i: i for i in fps}
    def top(i):
        while own[i] != i:
            i = own[i]
        return i
    ids = sorted(fps)
    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= 2:
                a, b = sorted((top(x), top(y)))
                own[b] = a
    return {i: top(i) for i in ids}


def test_fingerprints():
    for t in ("", "One", "a b", "The cat SAT on the mat\x0bthe cat sat é À", "a " * 200_000):
        assert simhash.fingerprint(t) == slow(t)


def test_components_equal_brute_force(docs, invented):
    r = random.Random(3)
    rows = [(k, invented(60, k)) for k in range(60)]
    for k in range(60):
        words = invented(400, k % 7).split()
        words[r.randrange(400)] = "zz"
        rows.append((100 + k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "  "), (50, rows[50][1])]
    got = {x.doc_id: x for x in simhash.near_duplicates(docs(rows)).collect()}
    fps = {i: slow(t) for i, t in rows}
    assert {i: x.fp & (2**64 - 1) for i, x in got.items()} == fps
    assert {i: x.component_id for i, x in got.items()} == classes(fps)


def test_crowded_variants_lose_no_link(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    values = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 7) if a != b}
    values |= {base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in ((1, 2, 3), (33, 40, 50), (5, 40, 41))} | {r.getrandbits(64) for _ in range(200)}
    signed = {i: v for i, v in enumerate(sorted(values))}
    for crowd in (4, 64, 10_000):
        fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in signed.values()], "fp long")
        edges = [(x.a & (2**64 - 1), x.b & (2**64 - 1)) for x in simhash.links(fps, crowd=crowd).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        number = {v: i for i, v in signed.items()}
        own = dict.fromkeys(signed)
        own.update({i: i for i in signed})
        def top(i):
            while own[i] != i:
                i = own[i]
            return i
        for a, b in edges:
            x, y = sorted((top(number[a]), top(number[b])))
            own[y] = x
        assert {i: top(i) for i in signed} == classes(signed)


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
