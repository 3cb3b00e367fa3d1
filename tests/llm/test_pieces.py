"""Subword encoding against the library, with byte spans, for several character maps."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from sonolith.llm import pieces
from sonolith.llm.queries import op12_piece_spans

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  two  spaces ", "▁ mark ▁▁x", "\0\x01 \x7f", "á é 🎉🎉 \U0010ffff", "<s>x</s> <0x41> <unk>", "\n\n\t x\r\n", "a" * 3000, "日本語 テキスト。", "Ｆｕｌｌ　Ｗidth ﬁ ㌔ ① ½ ​ é", "ÀÉ ß İ", "x" * 70 + " " + "é" * 70, "﻿bom"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(spark, docs, library, invented):
    texts = TEXTS + [invented(200, k) for k in range(20)] + ["long " + invented(60_000, 3)]
    rows = pieces.encode(docs([*enumerate(texts), (None, None), (5, "twice"), (5, "twice")]), PATH, decoded=True).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        text = "twice" if r.ids == library.encode("twice") and r.doc_id == 5 else "" if r.doc_id is None else texts[r.doc_id]
        assert r.ids == library.encode(text) and r.decoded == library.decode(r.ids)
        raw = text.encode()
        # without a character map the pieces cover the text from end to end
        assert all(a <= b for a, b in zip(r.begins, r.ends, strict=True)) and r.begins[1:] == r.ends[:-1]
        assert not raw or (r.begins[0], r.ends[-1]) == (0, len(raw))
        for i, a, b in zip(r.ids, r.begins, r.ends, strict=True):
            piece = library.id_to_piece(i)
            want = bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.encode()
            assert want.replace("▁".encode(), b" ") in (raw[a:b].replace("▁".encode(), b" "), b" " + raw[a:b].replace("▁".encode(), b" "))


def test_few_remembered(library, monkeypatch, invented):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    model = pieces.Model(PATH)
    for k in range(5):
        text = invented(300, k)
        assert model.encode([text, text])[1][0].tolist() == library.encode(text)
    assert len(model.known) < 1000


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_compiled_maps(rule, invented):
    """The longest prefixes of the library's own maps, and where each rewritten character came from."""
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    rules = dict(pieces._fields(dict(pieces._fields(theirs.serialized_model_proto()))[3]))
    ours = pieces.Normaliser(pieces.compiled_map(rules[2]), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)))
    assert len(ours.charmap) > 200_000
    for text in [*TEXTS, "  " + "　 ".join(TEXTS), invented(50, 1), "가각 ｶﾞ ㍿ 각"]:
        normal = ours.text(text)
        assert normal == theirs.normalize(text)
        first, end = ours.sources(text)
        raw, new = text.encode(), normal.encode()
        assert len(first) == len(end) == len(new) and (np.diff(first) >= 0).all() and (first <= end).all()
        if rule == "nfkc" and new:  # each stretch of one source is what the source alone becomes
            for a, b in {(a, b) for a, b in zip(first.tolist(), end.tolist(), strict=True) if b - a > 1}:
                got = bytes(c for c, x, y in zip(new, first, end, strict=True) if (x, y) == (a, b)).decode()
                alone = ours.charmap.get(raw[a:b].decode(), raw[a:b].decode()).replace(" ", "▁")
                assert got.strip("▁") == alone.strip("▁")


def test_offsets_of_a_map(tmp_path, spark, docs):
    """A model with a map: pieces of a ligature cover it whole, and merges see the rewritten text."""
    theirs = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()))[3]
    fields = [(k, v) for k, v in pieces._fields(open(PATH, "rb").read()) if k != 3]
    path = tmp_path / "nfkc.model"
    path.write_bytes(pieces._message([*fields, (3, theirs)]))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["ﬁnd  the ﬁ ㌔ ｶﾞ", "  ½ cup ", "①②③"]
    for r in pieces.encode(docs(enumerate(texts)).coalesce(1), str(path)).collect():
        text = texts[r.doc_id]
        assert r.ids == library.encode(text)
        raw = text.encode()
        for i, a, b in zip(r.ids, r.begins, r.ends, strict=True):
            raw[a:b].decode()  # whole characters, but where bytes stand for one
            if library.id_to_piece(i) == "▁find":
                assert raw[a:b].decode() == "ﬁnd"
    with pytest.raises(Exception, match="byte fallback"):
        no = tmp_path / "no.model"
        no.write_bytes(pieces._message([(1, pieces._message([(1, b"a")])), (2, pieces._message([(3, 2)]))]))
        pieces.Model(str(no))


def test_decode(spark, library):
    df = spark.createDataFrame([(1, library.encode("some text"), "z"), (2, [], "z"), (3, None, "z")], "id int, ids array<int>, decoded string")
    assert {r.id: r.decoded for r in pieces.decode(df, PATH).collect()} == {1: "some text", 2: "", 3: ""}


def test_query(spark, library):
    rows = op12_piece_spans(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
