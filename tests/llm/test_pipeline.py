import random

import pytest

import corpus_pipeline
from sonolith.llm import tokenpack
from sonolith.llm.queries import TOKENIZER

from .test_decontaminate import slow as slow_hits
from .test_linededup import slow as slow_lines
from .test_simhash import classes
from .test_simhash import slow as slow_print


@pytest.fixture
def tables(spark, docs, invented, tmp_path):
    r = random.Random(1)
    good = [invented(150 + k, k) for k in range(80)]
    bench = [(k, invented(40, 700 + k, 40)) for k in range(5)]
    rows = list(enumerate(good))
    rows += [(100 + k, good[k]) for k in range(5)] + [(110 + k, good[k + 10] + " end") for k in range(5)]
    rows += [(120 + k, good[k + 20] + "\n" + bench[k][1]) for k in range(5)]
    rows += [(200 + k, " ".join(w + r.choice(["$$$", "&&&"]) for w in good[k].split())) for k in range(60)] + [(300, None), (301, "")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(not 200 <= i < 300), 0) for i, _ in rows if i % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), bench


def test_each_stage_against_brute_force(spark, tables):
    sf_dir, bench = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = lambda d: {x.doc_id: x.text for x in d.collect()}
    now = read(docs)
    by = dict(corpus_pipeline.STAGES)
    for name in list(by)[:-1]:
        docs = by[name](spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.cache()
        got = read(docs)
        if name == "quality_classifier":
            assert not any(200 <= i < 300 for i in got) and set(range(80)) <= set(got)
        elif name == "line_dedup":
            want, _ = slow_lines(sorted(now.items()))
            assert got == want and all(x.n_chars == (None if x.text is None else len(x.text)) for x in docs.collect())
        elif name == "simhash_near_dedup":
            own = classes({i: slow_print(t) for i, t in now.items()})
            assert set(got) == {i for i in now if own[i] == i}
        else:
            hits = {i: slow_hits(t, bench) for i, t in now.items()}
            assert set(got) == {i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
            assert set(got) != set(now)
        now = got
    packed = by["best_fit_packing"](spark, docs, sf_dir).collect()
    ids = tokenpack.WordEncoder(TOKENIZER).encode([t or "" for t in now.values()])
    assert sum(x.length for x in packed) == sum(len(i) + 1 for i in ids)


def test_run_equals_the_stages(spark, tables):
    sf_dir, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda d: sorted((x.doc_id, x.piece, x.ids_crc32) for x in d.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)


def test_empty_tables(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, tables):
    """Columns that the stages use themselves are passed on as they are."""
    sf_dir, _ = tables
    names = ("h1", "th", "key", "id", "n", "start", "fp", "_near_th", "_line_th", "score", "f", "x", "spans")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 30 or doc_id >= 300")
    for k in names:
        table = table.withColumn(k, table["doc_id"] % 7)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, table, sf_dir)
        assert kept.columns == table.columns, name
        assert kept.where(" or ".join(f"not (`{k}` <=> doc_id % 7)" for k in names)).count() == 0 < kept.count(), name
