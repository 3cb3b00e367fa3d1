"""Every operator on nulls, empty texts, repeated rows and extra columns with clashing names."""

import public_tokenizers
import pytest

from sonolith.llm import decontaminate, gam, linededup, rulelists, secretscan, simhash, suffixdedup, suffixtree, tokenpack
from sonolith.llm.components import components

CLASHES = ("id", "key", "of", "h1", "h2", "pos", "line", "th", "fp", "g", "s", "lo", "hi", "f", "y", "n", "c", "t", "block", "words", "length", "score", "component", "items", "spans", "kept", "n_words", "_key", "_id", "_n")


@pytest.fixture
def odd(spark):
    rows = [(1, "some plain words of a text " * 20), (1, "some plain words of a text " * 20), (2, None), (3, ""), (None, "a text without an id"), (None, None), (4, "\n\n \t"), (5, "É" * 3000), (6, "x")]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["zz"] * len(CLASHES)) for r in rows], f"doc_id long, text string, {extra}")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_one_row_for_each_row(spark, odd, labels):
    want = ids(odd)
    bench = spark.createDataFrame([(1, "plain words"), (None, None), (2, "")], "item_id long, text string").where("item_id is not null")
    for made in (
        secretscan.scan(odd), gam.train_and_score(odd, labels), rulelists.apply_rules(odd, labels), suffixdedup.dedup(odd), suffixtree.train_and_score(odd), decontaminate.find(odd, bench),
    ):
        assert ids(made) == want
    near = simhash.near_duplicates(odd)
    assert ids(near) == want
    zero = {r.component_id for r in near.collect() if r.fp == 0}
    assert zero == {2}


def test_packing_and_filters(spark, odd, labels):
    packed = tokenpack.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json"))
    assert ids(packed.where("piece = 0")) == ids(odd)
    for made in (gam.keep_good(odd, labels, threshold=0.0), linededup.dedup_lines(odd), simhash.keep_one(odd)):
        assert made.columns == odd.columns
    assert gam.keep_good(odd, labels, threshold=0.0).count() == odd.count()
    assert linededup.dedup_lines(odd).count() == odd.count()
    kept = simhash.keep_one(odd).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 2, 5, 6, None]


def test_components(spark):
    edges = [(1, 2), (2, 1), (2, 3), (7, 7), (9, 8), (20, 10), (10, 15), (15, 3)] + [(100 + k, 101 + k) for k in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 15: 1, 10: 1, 20: 1, 8: 8, 9: 8}
    assert {v for k, v in got.items() if k >= 100} == {100} and len(got) == 8 + 201
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
