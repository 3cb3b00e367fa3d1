import random
import re
from pathlib import Path
from urllib.parse import urlparse

import pytest

from sonolith.llm import linededup, queries
from sonolith.llm.common import scratch_dir


def shingles(x, width=12):
    return {x[k : k + width] for k in range(max(len(x) - width, 0) + 1)}


def slow(rows, threshold=0.8, width=12):
    """Kept texts and all links, by brute force over all pairs of distinct lines."""
    first = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= width:
                first[x] = min(first.get(x, (i, k)), (i, k))
    lines = sorted(first)
    own = {x: x for x in lines}
    def top(x):
        while own[x] != x:
            x = own[x]
        return x
    sh = {x: shingles(x, width) for x in lines}
    links = []
    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a], lines[b]
            c = len(sh[x] & sh[y])
            if c >= threshold * (len(sh[x]) + len(sh[y]) - c):
                links.append((x, y))
                own[top(x)] = top(y)
    keep = {}
    for x in lines:
        keep[top(x)] = min(keep.get(top(x), first[x]), first[x])
    text = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if len(x) < width or keep[top(x)] == (i, k)) for i, t in rows}
    return text, links


def corpus(invented):
    r = random.Random(8)
    stock = [invented(n, n, 300) for n in range(8, 60, 2)]
    rows = []
    for k in range(60):
        out = []
        for _ in range(r.randrange(1, 8)):
            words = r.choice(stock).split()
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = f"new{r.randrange(999)}"
            out.append(" ".join(words))
        rows.append((k, "\n".join([*out, "", "short", out[0], "É" * 20, "\taaaa" * r.randrange(1, 9)])))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 50_000), (104, "x" * 49_000 + "\n" + "x" * 11)]


def test_equals_brute_force(docs, invented):
    rows = corpus(invented)
    want, links = slow(rows)
    assert len(links) > 50
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(rows)).collect()}
    assert set(got) == set(want)
    assert got == want
    counts = {r.doc_id: r for r in linededup.dedup_lines(docs(rows), counts=True).collect()}
    assert all(counts[i].n_lines == len((t or "").split("\n")) for i, t in rows)
    assert sum(c.n_removed for c in counts.values()) > 100


def test_no_link_that_is_not_similar(spark, invented):
    lines = sorted({x for _, t in corpus(invented) if t for x in t.split("\n") if len(x) >= 12})
    table = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    near = {r.node: r.component for r in linededup.near_lines(table).collect()}
    _, links = slow(list(enumerate(lines)))
    number = {x: k for k, x in enumerate(lines)}
    own = {k: k for k in range(len(lines))}
    def top(k):
        while own[k] != k:
            k = own[k]
        return k
    for x, y in links:
        a, b = sorted((top(number[x]), top(number[y])))
        own[b] = a
    found = sum(near.get(k, k) == top(k) for k in range(len(lines)))
    assert found >= 0.98 * len(lines)
    assert all(top(a) == top(b) for a, b in near.items())


def test_extra_columns_and_repeated_rows(spark):
    line = "the same long line of words"
    rows = spark.createDataFrame([(1, line, 5, "q"), (1, line, 5, "q"), (2, line + "!\nother thing entirely", 6, None), (None, line, 7, "z")], "doc_id long, text string, pos long, h1 string")
    got = sorted(((r.doc_id, r.text, r.pos, r.h1) for r in linededup.dedup_lines(rows).collect()), key=str)
    assert len(got) == 4 and [x[1] for x in got if x[0] == 2] == ["other thing entirely"]


def test_native_plan(docs, invented):
    plan = linededup.dedup_lines(docs(corpus(invented)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)", plan.split("== Physical Plan ==")[1])


def test_empty_table(docs):
    assert linededup.dedup_lines(docs([])).count() == 0


def joined(near, n):
    """A representative of each of n lines by (node, component) rows."""
    of = {r.node: r.component for r in near.collect()}
    return [of.get(k, k) for k in range(n)]


def test_copies_of_one_line(spark, invented):
    """Copies that differ from a line in a word each, and from each other in two."""
    r = random.Random(4)
    base = invented(60, 1, 300).split()
    lines = {" ".join(base)}
    while len(lines) < 300:
        words = list(base)
        words[r.randrange(60)] = f"new{r.randrange(9999)}"
        lines.add(" ".join(words))
    lines |= {invented(40, 50 + k, 300) for k in range(30)}
    got = joined(linededup.near_lines(spark.createDataFrame(list(enumerate(sorted(lines))), "id long, line string"), width=5), len(lines))
    assert sorted(map(got.count, set(got)), reverse=True)[:2] == [300, 1]


def test_pairs_that_share_boilerplate(spark):
    """Lines of 84 % common text, each with one near copy: recall over links, and no link across."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    common = [word() for _ in range(42)]
    lines = []
    for _ in range(400):
        own = [word() for _ in range(8)]
        lines += [" ".join([*common, *own]), " ".join([*common, *own[:-1], word()])]
    got = joined(linededup.near_lines(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), width=5), len(lines))
    found = sum(got[k] == got[k + 1] for k in range(0, len(lines), 2))
    assert found >= 0.99 * 400 and len(set(got)) >= 400


def test_lines_without_blanks(docs):
    """Long lines of one word, runs of one character and lines on both sides of 75 and 100 characters."""
    r, rows = random.Random(5), []
    for k, signs in enumerate(["0123456789abcdef", [chr(0x4E00 + j) for j in range(900)], [chr(0x1F300 + j) for j in range(200)]]):
        for n in (90, 150, 400, 3000):
            line = [r.choice(signs) for _ in range(n)]
            rows.append("".join(line))
            line[r.randrange(2)] = "#"
            rows.append("".join(line))
    rows += ["y" * 20, "y" * 70, "y" * 90, "y" * 130, "ab" * 30, "ab" * 44, "ab" * 60, "x" * 50_000, "x" * 49_000]
    want, links = slow(list(enumerate(rows)))
    assert len(links) == 12 + 6 + 3 + 1
    assert {x.doc_id: x.text for x in linededup.dedup_lines(docs(list(enumerate(rows)))).collect()} == want


def test_query_on_short_lines(docs, tmp_path):
    """Exact lines of any length but empty ones go, and lines that differ in one character of some sixty."""
    menu = "the opening hours of this house on day 1 of the week are ten to six"
    rows = [(1, f"Read more\n\nShare\nok\n{menu}"), (2, f"Read more\n\nRead mare\nok\nx\n{menu.replace('1', '2')}"), (3, "x\nShare"), (4, "é\né\n ")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in queries.op7_fuzzy_lines(docs([]).sparkSession, str(tmp_path)).collect()}
    assert got == {1: (5, 0), 2: (6, 3), 3: (2, 2), 4: (3, 1)}


def test_no_link_of_a_large_group_is_dropped(spark, monkeypatch):
    """Without the longer keys' help: what shares a band is compared, in a group of any size and in blocks of any size."""
    monkeypatch.setattr(linededup, "LONGER", (32,))
    monkeypatch.setattr(linededup, "BLOCK", 16)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(40)]
    lines = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(40)]
    got = joined(linededup.near_lines(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), width=5), len(lines))
    assert got == [0] * len(lines)


def test_families_make_few_candidates(spark, monkeypatch):
    """A family of lines that agree in most bins but are not similar makes no row a pair; the links within it are found."""
    made = {}
    write = linededup.materialise

    def counted(df, name):
        table = write(df, name)
        made[name] = made.get(name, 0) + (table.count() if name == "across" else 0)
        return table

    monkeypatch.setattr(linededup, "materialise", counted)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    def changed(words, n):
        at = set(r.sample(range(len(words)), n))
        return [word() if k in at else x for k, x in enumerate(words)]
    base = [word() for _ in range(40)]
    family = [changed(base, 4) for _ in range(150)]
    lines = [" ".join(x) for x in family + [changed(x, 1) for x in family[:30]]]
    _, links = slow(list(enumerate(lines)), width=5)
    got = joined(linededup.near_lines(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), width=5), len(lines))
    number = {x: k for k, x in enumerate(lines)}
    assert len(links) >= 30 and all(got[number[x]] == got[number[y]] for x, y in links)
    assert made["across"] <= 4 * len(lines)


def rows_of_outer_joins(spark, since):
    """Rows that left joins on a line's id made in the executions from number `since` on."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(since, store.executionsCount()):
        one = store.executionsList(k, 1).apply(0).executionId()
        nodes, values = store.planGraph(one).allNodes(), store.executionMetrics(one)
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if "Join" in node.name() and re.search(r"\[(a_)?id#.*LeftOuter", node.desc()):
                for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_only_lines_with_companions_get_parities(spark, monkeypatch):
    """Lines that share over half of their text fill large groups; only those that have a companion there are joined with parities."""
    monkeypatch.setattr(linededup, "LONGER", (32,))
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    common = [word() for _ in range(28)]
    lines = []
    for k in range(300):
        own = [word() for _ in range(19)]
        lines.append(" ".join([*common, *own]))
        if k < 10:
            lines.append(" ".join([*common, *own[:-1], word()]))
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = joined(linededup.near_lines(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), width=5), len(lines))
    assert all(got[k] == got[k + 1] for k in range(0, 20, 2)) and len(set(got)) == 300
    assert rows_of_outer_joins(spark, since) <= len(lines)


def test_tables_that_are_read_go(docs, invented):
    """Of a run only the few tables stay that its result reads or that are small: signatures, keys and texts of candidates don't."""
    table = docs(corpus(invented))
    folder = Path(urlparse(scratch_dir(table.sparkSession)).path)
    before = set(folder.iterdir()) if folder.exists() else set()
    assert linededup.dedup_lines(table).count() == 65
    stay = {p.name[:-33] for p in set(folder.iterdir()) - before}
    assert "dropped" in stay and not stay & {"signatures", "shared", "candidate-lines", "parted", "opened"}


def test_agreeing_counts_equal_bytes(spark):
    r = random.Random(3)
    rows = []
    for _ in range(500):
        x = [r.randrange(256) for _ in range(32)]
        y = [b if r.random() < 0.6 else r.choice((b ^ 1 << r.randrange(8), r.randrange(256))) for b in x]
        long = lambda z: [int.from_bytes(bytes(z[k : k + 8]), "little", signed=True) for k in range(0, 32, 8)]
        rows.append((*long(x), *long(y), sum(a == b for a, b in zip(x, y))))
    names = [f"{x}{s}" for x in ("a_", "b_") for s in linededup.SKETCH]
    table = spark.createDataFrame(rows, ", ".join(f"{x} long" for x in names) + ", want int")
    assert table.where(linededup._agreeing("a_", "b_") != table.want).count() == 0
