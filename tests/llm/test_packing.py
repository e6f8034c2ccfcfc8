"""Packing against the plain tokenizer."""

import zlib

import numpy as np
import pytest

from linkrisk.llm import packing as P
from linkrisk.llm.queries import tokenizer_path

TEXTS = ["Hello, world! it's 2024", None, "", "   ", "naïve Éclair ÑANDÚ  \t x", "a\x0bb\x0cc\u00a0d\u2003e f\x1cg", "x" * 5000, "e\u0301 \u0301combining",
         "<|endoftext|> <|startoftext|>", "日本語 テスト ΣΑΣ İstanbul", "word " * 9000, "don't we'll I'm 'tis", "🙂🙃 emoji", "same", "same"]


@pytest.mark.parametrize("length", [2048, 7])
def test_round_trip(spark, length):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    df = spark.createDataFrame([(i, t, 9, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, start int, ids string").repartition(3)
    out = [r.asDict() for r in P.pack(df, tokenizer_path(), length).collect()]
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS)}
    for i, ids in want.items():
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum((r["ids"] for r in mine), []) == ids
        at = 0
        for r in mine:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
            at += r["length"]
    total = sum(map(len, want.values()))
    filled = np.zeros(total, int)
    for r in out:
        assert r["offset"] + r["length"] <= length
        filled[r["sequence_id"] * length + r["offset"]:][:r["length"]] += 1
    assert (filled == 1).all()  # no gap, no overlap, all but the last sequence full


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(df, tokenizer_path()).count() == 0


def test_sf(spark):
    """Cached chunks give the tokenizer's own ids on real texts."""
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(tokenizer_path()), P.encoder(tokenizer_path())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert np.frombuffer(enc.encode(r.text.encode()), enc.dtype).tolist() == tok.encode(r.text, add_special_tokens=False).ids


def test_new_chunks_go_to_the_tokenizer_together():
    class Counting:
        texts = 0

        def __init__(self, tok):
            self.tok = tok

        def encode_batch(self, texts, **kw):
            Counting.texts += len(texts)
            return self.tok.encode_batch(texts, **kw)

        def encode_batch_fast(self, texts, **kw):
            Counting.texts += len(texts)
            return self.tok.encode_batch_fast(texts, **kw)

    enc = P.Encoder(tokenizer_path())
    plain = enc.tok
    enc.tok = Counting(plain)
    texts = [" ".join(f"w{i}é́x{j}." for j in range(50)) for i in range(40)]
    want = lambda t: np.asarray(plain.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes()
    assert enc.encode_many([t.encode() for t in texts]) == [want(t) for t in texts]
    assert Counting.texts <= 2000 // P.TOGETHER + 1  # 2,000 chunks
    odd = "a <|endoftext|> b c<|startoftext|>d ́e 🙂 " + texts[0].upper()
    assert enc.encode(odd.encode()) == want(odd)
