"""Stupid backoff against a plain count."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from linkrisk.llm import lm as L
from linkrisk.llm.base import CHUNK, WHITE, word_hashes


def brute(texts, order=3, alpha=0.4, least=2):
    docs = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    c = Counter(tuple(d[i - n + 1:i + 1]) for d in docs for n in range(1, order + 1) for i in range(n - 1, len(d)))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        s = 0.0
        for i in range(len(d)):
            for n in range(min(order, i + 1), 1, -1):
                g = tuple(d[i - n + 1:i + 1])
                if c[g] >= least:
                    s += math.log(c[g] / c[g[:-1]]) + (order - n) * math.log(alpha)
                    break
            else:
                s += math.log(c[(d[i],)] / total) + (order - 1) * math.log(alpha)
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("chars", [300, 8_000_000])
def test_matches_plain_counts(spark, rng, monkeypatch, chars):
    monkeypatch.setattr(L, "BLOCK_CHARS", chars)
    monkeypatch.setattr(L, "PARTITION_CHARS", chars)
    words = [f"W{i}" for i in range(40)] + ["the", "The", "ñu"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(150)] + ["the the the the"] * 30 + [None, "", " \n\t ", "one"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int")
    got = {r.doc_id: r for r in L.score_documents(df).collect()}
    assert len(got) == len(texts)
    for i, (n, s) in enumerate(brute(texts)):
        assert got[i].tokens == n and math.isclose(got[i].log_score, s, rel_tol=1e-9, abs_tol=1e-9)


def test_empty(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_packing_of_sorted_hashes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
        assert (L.unpack_sorted(L.pack_sorted(x)) == x).all()
    c = rng.integers(0, 1 << 32, 100)
    assert (L.unpack_counts(L.pack_counts(c)) == c).all()


def test_words_of_long_texts():
    """Chunks are cut between words only."""
    text = b"Ab cd\tEF " * (CHUNK // 4) + b"x" * (CHUNK + 5) + b" tail\x0bend"
    doc, h, _ = word_hashes([b"first", None, text, b""], WHITE)
    words = [b"first"] + text.lower().split()
    assert len(h) == len(words) and (doc == np.array([0] + [2] * (len(words) - 1))).all()
    small = word_hashes([w for w in dict.fromkeys(words)])[1]
    key = dict(zip(dict.fromkeys(words), small))
    assert (h == np.array([key[w] for w in words], np.uint64)).all() and len(set(key.values())) == len(key)


def test_counts_beyond_32_bits():
    """Counts survive packing, and are added up over blocks, above 2^32."""
    x = np.array([1, 2**32 - 1, 2**32, 5, 13 * 10**9, 2**32 + 7], np.int64)
    assert L.unpack_counts(L.pack_counts(x)).tolist() == x.tolist()
    assert L.unpack_counts(L.pack_counts(x[:0])).tolist() == []
    grams = [np.array(g, np.uint64) for g in ([3, 9], [3, 7, 9], [7])]
    counts = [np.array(c, np.uint32) for c in ([3 * 10**9, 1], [3 * 10**9, 2, 4], [2**32 - 1])]
    got = L.add_up([L.pack_sorted(g) for g in grams], [L.pack_counts(c) for c in counts])
    assert [L.unpack_counts(b).tolist() for b in got] == [[6 * 10**9, 5], [6 * 10**9, 2**32 + 1, 5], [2**32 + 1]]
    assert L.narrow(x).tolist() == x.tolist() and L.narrow(x[:2]).dtype == np.uint32
