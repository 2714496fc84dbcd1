"""SentencePiece ids and texts against the sentencepiece library, with nulls, odd signs, repeated rows and clashing columns."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import sentencepiece
from sieveline.llm import sentence_pieces

SIGNS = [*" \t\n▁abcdeéſﬁ😀مرحبا日本語،.,'\"<>0x\x00\xa0́　ABC١", "    ", "the", "ing", " of", ".”", ");\r", "a1", "<unk>", "<0x0A>"]


def texts(n: int, longest: int = 60) -> list[str]:
    rng = random.Random(n)
    return ["", " ", "▁", "  a  b  ", "x" * 3000, " " * 100 + "y", "日" * 500] + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_bpe_ids_equal_the_library():
    own, library = sentence_pieces.Pieces(sentence_pieces.default_model()), sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    for text in texts(2000):
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids).decode() == library.decode(ids.tolist()), text


def test_unigram_ids_equal_the_library(tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    lines = [" ".join(rng.choices(words, k=8)) for _ in range(400)]
    for fallback in (False, True):
        for rule in ("identity", "nmt_nfkc"):
            kept = io.BytesIO()
            sentencepiece.SentencePieceTrainer.train(
                sentence_iterator=iter(lines), model_writer=kept, vocab_size=400 if fallback else 140, byte_fallback=fallback, normalization_rule_name=rule, remove_extra_whitespaces=rule != "identity", hard_vocab_limit=False, minloglevel=2
            )
            path = tmp_path / f"{fallback}{rule}.model"
            path.write_bytes(kept.getvalue())
            own, library = sentence_pieces.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
            for text in lines[:50] + texts(300):
                ids = own.encode(text)
                assert ids.tolist() == library.encode(text), (fallback, rule, text)
                assert own.decode(ids).decode() == library.decode(ids.tolist()), (fallback, rule, text)


def test_every_row_is_coded(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    rows = [(i, t, "x") for i, t in enumerate(texts(50))] + [(None, "no id", "x"), (2**53 + 1, None, "x"), (3, "again", "x"), (3, "again", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    found = sorted(sentence_pieces.coded(frame).collect(), key=str)
    wanted = []
    for doc, text, _ in rows:
        ids = library.encode(text or "")
        wanted.append((doc, ids, len(ids), sum(map(library.is_byte, ids)), zlib.crc32(np.array(ids, "<i4").tobytes()), library.decode(ids) == (text or "")))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert any(not r["round_trip"] for r in found) and sum(r["round_trip"] for r in found) > 20
    assert sentence_pieces.coded(frame.where("false")).count() == 0
    broken = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert [(r["doc_id"], r["round_trip"]) for r in sentence_pieces.coded(broken).collect()] == [(1, False)]
