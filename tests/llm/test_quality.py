import random
import re
import zlib

import numpy as np
import pytest

from sonolith.llm import gam, rulelists, textstats


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for k in range(len(words) - 2):
        at.setdefault(tuple(words[k : k + 3]), []).append(k)
    hit = {p + d for ps in at.values() if len(ps) > 1 for p in ps for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = ["", " \n\t", "#", "a b c a b c", "a a a a", "a b", "x\n\nx\n x\ny\x0b\nx", "é ü ß é ü ß é ü ß", "<a|b> & c\r\n" * 50, "\x1c\x85 \xa0"]


def test_counts_equal_brute_force(docs, invented):
    texts = TEXTS + [invented(n, n, 9) for n in (5, 60, 300)]
    for t in texts:
        assert textstats.rule_counts(t) == slow_counts(t)
    got = textstats.rule_stats(docs([*enumerate(texts), (-1, None)])).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {**{k: slow_counts(t) for k, t in enumerate(texts)}, -1: (0,) * 5}


def junk(text, seed):
    r = random.Random(seed)
    return " ".join(w + r.choice(["$$$", "&&&", "###"]) for w in text.split())


@pytest.fixture
def labelled(spark, docs, invented):
    rows = [(k, invented(80 + k % 60, k) if k % 4 else junk(invented(80, k), k)) for k in range(400)] + [(900, None), (901, ""), (902, "one")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(400)] + [(901, None, None), (7, 1, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    return docs(rows), labels


def test_gam_learns_and_is_additive(labelled):
    table, labels = labelled
    rows = textstats.features(table)
    model = gam.train(rows, labels)
    got = {r.doc_id: r.score for r in gam.scores(rows, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.3) == (k % 4 > 0) for k in held]) >= 0.97
    assert {r.doc_id: r.score for r in gam.train_and_score(table, labels).collect()} == got
    x = np.array([textstats.features_of("a b c")])
    parts = sum(t[np.searchsorted(e, x[0, k], "right")] for k, (t, e) in enumerate(zip(model.tables, model.edges)))
    assert model.logit(x)[0] == pytest.approx(model.bias + parts + sum(t[np.searchsorted(model.coarse[i], x[0, i], "right"), np.searchsorted(model.coarse[j], x[0, j], "right")] for (i, j), t in model.pairs.items()))


def test_held_out_labels_do_not_matter(spark, labelled):
    table, labels = labelled
    held = {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    flipped = labels.selectExpr("doc_id", f"if(doc_id in ({','.join(map(str, held))}), 1 - quality, quality) quality", "toxic")
    a, b = (sorted(gam.train_and_score(table, x).collect()) for x in (labels, flipped))
    assert a == b


def test_pairs_find_an_interaction():
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gam.fit(x, y, n_pairs=1, pair_rounds=60)
    assert list(model.pairs) == [(0, 1)] and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_keep_good(labelled):
    table, labels = labelled
    kept = gam.keep_good(table, labels)
    scored = {r.doc_id: r.score for r in gam.train_and_score(table, labels).collect()}
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, s in scored.items() if s >= 0.3}


def test_one_class_or_no_labels(spark, labelled):
    table, labels = labelled
    for some in (labels.where("quality = 1"), labels.limit(0)):
        assert gam.train_and_score(table, some).where("score >= 0.3").count() == 403
        assert rulelists.apply_rules(table, some).where("kept = base_failed").count() == 0


def test_decision_list(labelled):
    table, labels = labelled
    got = {r.doc_id: r for r in rulelists.apply_rules(table, labels).collect()}
    assert len(got) == 403
    for k in (900, 901, 902):
        assert got[k].base_failed and not got[k].kept
    assert all(got[k].kept == (k % 4 > 0) for k in range(400) if not got[k].base_failed)


def test_sequential_covering_learns_two_rules():
    r = np.random.default_rng(0)
    x = {"a": r.uniform(0, 1, 3000), "b": r.uniform(0, 1, 3000), "c": r.uniform(0, 1, 3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    rules = rulelists.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= rulelists._holds(x, rule.literals)
    assert len(rules) >= 2 and (hit == bad).mean() > 0.95
    assert rulelists.learn({"a": x["a"]}, np.zeros(3000, bool)) == []


def test_empty_table(docs, labelled):
    _, labels = labelled
    assert gam.train_and_score(docs([]), labels).count() == 0
    assert rulelists.apply_rules(docs([]), labels).count() == 0
    assert gam.keep_good(docs([]), labels).count() == 0
