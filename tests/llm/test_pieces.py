"""Pieces age out by halves, and matches that go to the tokenizer's model alone give the library's ids."""

import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyline.llm import id_files
from tallyline.llm.pieces import Pieces


def test_pieces_in_use_stay_when_others_are_dropped():
    asked = []
    pieces = Pieces(public_tokenizers.PATTERN, lambda m: asked.append(m) or m, "".join)
    pieces.cached = 20
    for i in range(40):
        word = "x" + chr(97 + i % 26) + chr(97 + i // 26)
        assert "".join(pieces.values_of(f"often {word}")) == f"often {word}"
        assert len(pieces) + len(pieces.older) <= 24
    assert asked.count("often") == 1                            # encoded again after each clearing before


def test_matches_get_the_librarys_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, (pieces, _) = Tokenizer.from_file(path), id_files._encoder(path)
    assert pieces.encode is not pieces.whole
    for text in ("Hello, world's 'tis it''s!'s", "naïve café Straße ÿ­  x ¡¿", "  a\n\n b\t\0\1 \x7f", "日本語 ƒoo \U00010780x", "123 4５ don't 'S", " ", "", "tail "):
        ids = whole.encode(text, None, False, False).ids
        assert id_files.encode(pieces, text) == struct.pack(f"<{len(ids)}I", *ids)


def test_the_pipelines_last_stage_keeps_fewer_pieces(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    assert corpus_pipeline.BPE_PIECES < id_files.CACHED
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.encoding(spark, docs, "").collect()}.get(2) == 0
