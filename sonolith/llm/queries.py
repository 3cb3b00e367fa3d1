"""The queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import decontaminate, divergence, gam, linededup, pieces, resample, rulelists, secretscan, simhash, suffixdedup, suffixtree, tokenpack, warc
from .common import held_out

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.train_and_score(table(spark, sf_dir, "documents"))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tokenpack.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "lexed")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = gam.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"), width=5, short=True, counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulelists.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"), window=200)


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    flag = decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), flag.alias("contaminated"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents"), PIECES, decoded=True)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"), F.xxhash64("begins", "ends").alias("spans_xxh64"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_warc_segments": op2_warc_segments,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_additive_model": op5_additive_model,
    "op6_simhash_variants": op6_simhash_variants,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_decision_lists": op8_decision_lists,
    "op9_induced_suffixes": op9_induced_suffixes,
    "op10_suffix_automaton": op10_suffix_automaton,
    "op11_source_divergence": op11_source_divergence,
    "op12_piece_spans": op12_piece_spans,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_segments": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
        h AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS holder FROM p)
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
               CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN holder <> page_id THEN holder END AS refers_to
        FROM h""",
    "op9_induced_suffixes": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        p AS (SELECT doc_id, k, md5(b[k + 1:k + 200]) AS h FROM d, LATERAL (SELECT unnest(range(0, n - 199)) AS k)),
        r AS (SELECT doc_id, k FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
        i AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS g
              FROM (SELECT *, (k > coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k), -1000) + 200)::INT AS fresh FROM r)),
        s AS (SELECT doc_id, min(k) AS lo, max(k) + 200 AS hi FROM i GROUP BY doc_id, g),
        e AS (SELECT d.doc_id, b, n, coalesce(lag(hi) OVER (PARTITION BY d.doc_id ORDER BY lo), 0) AS a, lo AS z, hi FROM d JOIN s USING (doc_id)),
        k AS (SELECT doc_id, string_agg(hex(b[a + 1:z]), '' ORDER BY z) || max_by(hex(b[hi + 1:]), z) AS kept, count(*) AS spans, sum(hi - z) AS gone FROM e GROUP BY doc_id)
        SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN kept IS NULL THEN b ELSE from_hex(kept) END) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op10_suffix_automaton": r"""
        WITH w AS (SELECT regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, kind, id
                   FROM (SELECT doc_id AS id, 'doc' AS kind, coalesce(text, '') AS t FROM documents UNION ALL SELECT item_id, 'item', coalesce(text, '') FROM benchmark)),
        win AS (SELECT DISTINCT id AS item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
                FROM w, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k) WHERE kind = 'item' AND len(w) > 0),
        dg AS (SELECT id AS doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM w, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k) WHERE kind = 'doc'),
        hit AS (SELECT doc_id, item_id, k, n FROM dg JOIN win USING (n, g)),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, LATERAL (SELECT unnest(range(k, k + n)) AS p) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
        SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM w LEFT JOIN cov ON id = cov.doc_id LEFT JOIN its ON id = its.doc_id WHERE kind = 'doc'""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
        ln AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS cnt, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + ln.v) AS p
              FROM gn JOIN kept USING (lang) JOIN ln USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN (SELECT a.lang, a.source AS s1, b.source AS s2, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
                            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.s1 = a.source AND x.s2 = b.source),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (total + 1)) // (ln.n + ln.v) AS q FROM kept JOIN ln USING (lang)),
        t AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE cnt > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM t))
        SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op13_importance_resampling": r"""
        WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) r(i)),
        x AS (SELECT 'd' AS side, row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
        w AS (SELECT side, k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
        o AS (SELECT side, k, unnest(w) AS term FROM w),
        h AS (SELECT term, hex(encode(term)) AS x FROM (SELECT DISTINCT term FROM o)),
        b AS (SELECT term, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT)),
                     lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
        n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM o JOIN b USING (term) GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sa + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (ta + 10000)::DOUBLE)))::BIGINT AS gain FROM n, (SELECT sum(s) AS sa, sum(t) AS ta FROM n)),
        m AS (SELECT k, count(*) AS c, sum(gain)::BIGINT AS g FROM o JOIN b USING (term) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY k),
        z AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce((g - ((g % c) + c) % c) // c, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
              FROM w LEFT JOIN m USING (k) WHERE side = 'd'),
        s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM z),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)""",
}
