import random
import re

from sonolith.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def slow(text, items):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for i, t in items:
        ws = WORD.findall(lower(t))
        n = min(13, len(ws))
        windows = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(i)
    return len(words), len(hit), sorted(found)


def case(invented):
    r = random.Random(2)
    items = [(k, invented(40, 900 + k, 40)) for k in range(12)] + [(20, None), (21, "--"), (22, "One two"), (23, "one"), (24, "uw4 " * 20), (25, invented(40, 900, 40)), (26, "É À é")]
    rows = [(0, None), (1, ""), (2, "..."), (3, "one TWO one"), (4, "uw4 " * 13), (5, "uw4 " * 12), (6, "xx É À é xx")]
    for k in range(10, 40):
        words = invented(120, k, 40).split()
        for _ in range(r.randrange(3)):
            ws = items[r.randrange(12)][1].split()
            a = r.randrange(30)
            at = r.randrange(100)
            words[at:at] = ws[a : a + r.randrange(5, 30)]
        rows.append((k, ", ".join(words)))
    return rows, items


def test_equals_brute_force(spark, docs, invented):
    rows, items = case(invented)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: slow(t, items) for i, t in rows}
    assert any(w[1] for w in want.values())
    for max_words in (10**6, 90):
        got = decontaminate.find(docs(rows), bench, max_words=max_words).collect()
        assert {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in got} == want
        assert all(sum(s.end - s.start for s in x.spans) == x.n_hit for x in got)


def test_clean(spark, docs, invented):
    rows, items = case(invented)
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {i for i, t in rows for n, h, _ in [slow(t, items)] if h and 20 * h >= n}
    table = docs([*rows, (None, "nothing of theirs")])
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - bad | {None}
    cut = {x.doc_id: x.text for x in decontaminate.clean(table, bench, drop=False).collect()}
    assert cut[3] == "" and cut[6] == "xx  xx" and set(cut) == {i for i, _ in rows} | {None}


def test_clean_in_several_passes(spark, docs, invented):
    rows, items = case(invented)
    table, bench = docs([*rows, *rows[:9], (None, "one"), (None, None)]), spark.createDataFrame(items, "item_id long, text string")
    for drop in (True, False):
        one, many = (sorted(((x.doc_id, x.text) for x in decontaminate.clean(table, bench, drop=drop, max_words=n).collect()), key=str) for n in (10**6, 90))
        assert one == many and (len(one) < table.count() if drop else len(one) == table.count())


def test_ids_of_any_type_and_clashing_columns(spark):
    table = spark.createDataFrame([("a", "one two", "x", 1), ("b", None, "y", 2), (None, "one", "z", 3)], "doc_id string, text string, _spans string, th int")
    bench = spark.createDataFrame([("i", "one"), (None, "two"), ("j", None)], "item_id string, text string")
    for n in (10**6, 1):
        assert sorted(((x.doc_id, x["items"]) for x in decontaminate.find(table, bench, max_words=n).collect()), key=str) == sorted([("a", ["i", None]), ("b", []), (None, ["i"])], key=str)
        assert [tuple(x) for x in decontaminate.clean(table, bench, max_words=n).collect()] == [("b", None, "y", 2)]
        assert decontaminate.clean(table, bench, max_words=n, drop=False).columns == table.columns


def test_many_equal_short_items():
    """The time of a word does not grow with the items that are equal."""
    import time

    automaton = decontaminate.Automaton([(k, ["a"]) for k in range(5000)], 13)
    began = time.perf_counter()
    spans, items, _ = automaton.hits(["a"] * 20_000)
    assert len(items) == 5000 and spans == [(0, 20_000)] and time.perf_counter() - began < 1


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs([]), none).count() == 0
    assert decontaminate.find(docs([(1, "a b")]), none).first().n_hit == 0
